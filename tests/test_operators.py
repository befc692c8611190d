"""Operators without SQL twins against brute force on small inputs."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from cotejo import skew
from cotejo.operators import boxes, extract, finance, graph, images, lines, pdfbytes, recon, tiles

RNG = random.Random(7)


def test_match_items_equals_the_greedy_loop(spark, monkeypatch):
    words = ["pan", "leche entera", "leche", "arroz blanco", "arroz", "azucar", "aceite de oliva", "aceite"]

    def side(n_docs, most):
        return [(d, i, RNG.choice(words) + RNG.choice(["", " x", " 1kg"])) for d in range(n_docs) for i in range(RNG.randint(1, most))]

    sri, pdf = side(6, 14), side(6, 14)
    want = set()
    for d in range(6):
        used = set()
        for s in sorted(x for x in sri if x[0] == d):
            best, score = None, -1.0
            for p in sorted(x for x in pdf if x[0] == d):
                if p[1] not in used:
                    r = SequenceMatcher(None, s[2].upper(), p[2].upper()).ratio()
                    if r > score:
                        best, score = p[1], r
            if best is not None and score >= 0.6:
                used.add(best)
                want.add((d, s[1], best))
    cols = "doc_id bigint, item_no bigint, descripcion string"
    a, b = spark.createDataFrame(sri, cols), spark.createDataFrame(pdf, cols)
    one_pass = {(r["doc_id"], r["sri_no"], r["pdf_no"]) for r in recon.match_items(a, b).collect()}
    assert one_pass == want
    # tiny pieces make every document a long one
    monkeypatch.setattr(recon, "CHUNK", 4)
    assert {(r["doc_id"], r["sri_no"], r["pdf_no"]) for r in recon.match_items(a, b).collect()} == want
    left = recon.unmatched_items(recon.match_items(a, b), a, b)
    assert left.count() == len(sri) + len(pdf) - 2 * len(want)


def test_similar_lines_equals_all_pairs(spark, monkeypatch):
    base = ["total a pagar 10", "total a pagar 11", "iva 15%", "otra cosa", "otra casa", "x"]
    docs = [(d, "\n".join(RNG.choice(base) + RNG.choice(["", "!", " "]) for _ in range(25))) for d in range(4)]
    df = lines.split_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    monkeypatch.setattr(lines, "LINE_CHUNK", 8)
    got = {}
    for r in lines.similar_lines(df).collect():
        got.setdefault(r["doc_id"], []).append((r["i"], r["j"]))
    for d, text in docs:
        rows = [x.strip() for x in text.split("\n") if x.strip()]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0.7 <= SequenceMatcher(None, rows[i], rows[j]).ratio() < 1.0]
        assert sorted(got.get(d, [])) == pairs
    first = [(r["i"], r["j"]) for r in lines.similar_lines(df, limit=10).where("doc_id = 0").orderBy("i", "j").collect()]
    assert first == sorted(got[0])[:10]


def test_label_and_context_amounts(spark):
    text = "FACTURA\nSUBTOTAL SIN IMPUESTOS\n\n54,00\nIVA 15%: 8.10\nTOTAL: $62.10"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = lines.label_next_lines(df).first()
    assert (r["subtotal_sin_impuestos"], r["valor_total"]) == (54.0, 54.0)
    # the first number of the tax line is its rate
    assert r["iva_15"] == 8.10
    assert lines.context_amounts(df).first().asDict() == {"doc_id": 1, "subtotal": None, "iva": 8.1, "total": 62.1}
    assert lines.tail_candidates(df).first()["total"] == 62.1


def test_merge_boxes_equals_the_greedy_loop(spark):
    rows = [(1, i, float(RNG.randint(0, 60)), float(RNG.randint(0, 60)), RNG.randint(5, 40), RNG.randint(5, 40)) for i in range(40)]
    data = [(a, i, x, y, x + w, y + h) for a, i, x, y, w, h in rows]

    def iou(p, q):
        inter = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
        return inter / (area(p) + area(q) - inter + 1e-6)

    order, used, keep = sorted(data, key=lambda b: (b[3] + 0.1 * b[2], b[1])), set(), set()
    for b in order:
        if b[1] not in used:
            keep.add(b[1])
            used |= {c[1] for c in data if c[1] not in used and iou(b, c) > 0.2} | {b[1]}
    df = spark.createDataFrame(data, "image_id bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double")
    assert {r["box_no"] for r in boxes.merge_boxes(df).collect()} == keep


def test_word_overlap_is_strict(spark):
    words = [(1, 1, 0, 0.0, 10.0, 10.0, 20.0, "a"), (1, 1, 1, 5.0, 10.0, 15.0, 20.0, "b"), (1, 1, 2, 8.9, 10.04, 18.9, 20.0, "c"), (1, 1, 3, 0.0, 11.0, 10.0, 20.0, "d")]
    df = spark.createDataFrame(words, "doc_id bigint, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double, text string")
    assert [(r["a_word_no"], r["b_word_no"]) for r in boxes.word_overlaps(df, cell=4.0).collect()] == [(1, 2)]


def test_band_labels_skip_the_excluded_row(spark):
    w = "doc_id bigint, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double, text string"
    words = spark.createDataFrame(
        [(1, 1, 0, 0.0, 10.0, 50.0, 20.0, "VALOR"), (1, 1, 1, 60.0, 10.0, 90.0, 20.0, "SIN"), (1, 1, 2, 95.0, 10.0, 120.0, 20.0, "SUBSIDIO"), (1, 1, 3, 130.0, 10.0, 150.0, 20.0, "99,00"),
         (1, 1, 4, 0.0, 60.0, 50.0, 70.0, "VALOR"), (1, 1, 5, 130.0, 60.0, 150.0, 70.0, "1.234,50")], w)
    labels = spark.createDataFrame([(1, 1, 0, 0.0, 10.0, 50.0, 20.0), (1, 1, 1, 0.0, 60.0, 50.0, 70.0)], "doc_id bigint, page int, label_no bigint, x0 double, y0 double, x1 double, y1 double")
    text = spark.createDataFrame([(1, "")], "doc_id bigint, text string")
    assert boxes.label_amounts_in_band(words, labels, text).first()["valor_total"] == 1234.5


def test_exact_quantiles_equal_numpy(spark):
    data = [(k, float(RNG.randint(0, 50)) if k == 0 else RNG.random()) for k in range(3) for _ in range(700)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r["k"]: r for r in skew.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}, accuracy=50).collect()}
    for k in range(3):
        v = [x for j, x in data if j == k]
        for name, p in (("a", 0.5), ("b", 0.95), ("c", 0.0)):
            assert math.isclose(got[k][name], float(np.percentile(v, p * 100)), rel_tol=1e-12)


def test_small_keys_are_ranked_whole(spark):
    data = [(k, RNG.random()) for k, n in enumerate((1, 2, 3, 7, 200)) for _ in range(n)]
    got = {r["k"]: r["a"] for r in skew.exact_quantiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", {"a": 0.75}).collect()}
    for k, value in got.items():
        assert math.isclose(value, float(np.percentile([v for j, v in data if j == k], 75)), rel_tol=1e-12)


def test_chunked_lag_crosses_chunks(spark):
    df = spark.createDataFrame([(k, i, i * 10) for k in range(2) for i in (0, 1, 7, 9, 23)], "k int, i int, v int")
    rows = skew.chunked_lag(df, ["k"], "i", F.floor(F.col("i") / 5), ["v"]).orderBy("k", "i").collect()
    assert [r["prev_v"] for r in rows] == [None, 0, 10, 70, 90] * 2


def test_components_equal_flood_fill(spark):
    grid = {(y, x) for y in range(12) for x in range(12) if RNG.random() < 0.55}
    seen, want = set(), set()
    for start in sorted(grid):
        if start in seen:
            continue
        stack, comp = [start], set()
        while stack:
            c = stack.pop()
            if c in grid and c not in comp:
                comp.add(c)
                stack += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        seen |= comp
        want.add(frozenset(comp))
    df = spark.createDataFrame([(1, y, x) for y, x in grid], "image_id bigint, ty int, tx int")
    got = {}
    for r in graph.connected_tiles(df).collect():
        got.setdefault(r["component"], set()).add((r["ty"], r["tx"]))
    assert {frozenset(c) for c in got.values()} == want


def test_double_compression_equals_numpy(spark):
    rng = np.random.default_rng(0)
    px = [rng.integers(0, 256, 64) for _ in range(60)]
    df = spark.createDataFrame([(1, 0, i, [int(v) for v in p]) for i, p in enumerate(px)], "image_id bigint, ty int, tx int, px array<smallint>")
    m = tiles._dct_matrix()
    assert np.allclose(m @ m.T, np.eye(8))
    coef = np.array([m @ (p.reshape(8, 8) - 128.0) @ m.T for p in px])
    r = tiles.double_compression(df).first()
    ac = np.array([coef[:, a, b] for a, b in tiles.AC_TERMS])
    assert math.isclose(r["ac_variance"], ac.var(), rel_tol=1e-9) and math.isclose(r["dc_variance"], coef[:, 0, 0].var(), rel_tol=1e-9)
    peaks = []
    for values in ac:
        hist = np.histogram(np.rint(np.clip(values, -60, 60)), bins=121, range=(-60, 60))[0]
        spec = np.abs(np.fft.rfft(np.convolve(hist, np.array([1, 2, 3, 2, 1]) / 9, mode="same")))[1:]
        med = np.median(spec)
        peaks.append(int((spec > med + 6 * 1.4826 * (np.median(np.abs(spec - med)) + 1e-6)).sum()))
    assert r["num_picos"] == max(peaks) and math.isclose(r["consistencia"], sum(p >= 3 for p in peaks) / 5)
    simple = tiles.double_compression_simple(df).first()
    assert math.isclose(simple["ac_variance"], coef[:, 1:, 1:].var(), rel_tol=1e-9)


def test_copy_move_needs_a_far_and_clear_twin(spark):
    base = [[RNG.randint(0, 127) for _ in range(8)] for _ in range(60)]
    rows = [(1, i, float(i * 3), 0.0, d) for i, d in enumerate(base)] + [(1, 60, 400.0, 0.0, base[5]), (1, 61, 31.0, 0.0, base[10])]
    kp = spark.createDataFrame(rows, "image_id bigint, kp_id bigint, x double, y double, descriptor array<tinyint>")
    meta = spark.createDataFrame([(1, 1000, 1000)], "image_id bigint, width int, height int")
    assert tiles.copy_move(kp, meta).first()["coincidencias"] == 1


def test_formula_examples(spark):
    rows = [(1, 13.17, 1.98, 20.0), (2, 100.0, 0.0, 100.0), (3, 100.0, 0.0, 100.01), (4, 100.0, 0.0, 105.5), (5, 54.0, 8.1, 62.1)]
    df = spark.createDataFrame(rows, "doc_id int, subtotal double, iva double, total_declarado double").selectExpr("*", "0.0D descuentos", "0.0D retenciones", "0.0D propina")
    got = {r["doc_id"]: (r["formula_correcta"], r["diferencia"]) for r in finance.check_formula(df).collect()}
    assert got == {1: (False, 4.85), 2: (True, 0.0), 3: (True, 0.01), 4: (False, 5.5), 5: (True, 0.0)}


def test_fallback_totals(spark):
    amounts = "doc_id int, subtotal double, iva double, total double"
    frame = lambda rows: spark.createDataFrame(rows, amounts)
    context = frame([(1, None, None, None), (2, 10.0, None, 11.5), (3, None, None, None)])
    inferred = frame([(1, 20.0, 3.0, 23.0)])
    tail = spark.createDataFrame([(1, None)], "doc_id int, total double")
    stats = frame([(3, None, None, 115.0)])
    fields = spark.createDataFrame([(1, None, None)], "doc_id int, total double, subtotal double")
    got = {r["doc_id"]: (r["subtotal"], r["iva"], r["total"], r["metodo"]) for r in finance.fallback_totals(context, inferred, tail, stats, fields).collect()}
    assert got == {1: (20.0, 3.0, 23.0, "contexto"), 2: (10.0, 1.5, 11.5, "contexto"), 3: (100.0, 15.0, 115.0, "ultimo_recurso")}


def test_parser_checks_are_three_valued(spark):
    t = spark.createDataFrame([(1, 10.0, None, None, 10.0, None, 1.5, 11.5), (2, None, None, None, None, None, None, 5.0)], "doc_id int, subtotal15 double, subtotal0 double, subtotal_no_objeto double, subtotal_sin_impuestos double, descuento double, iva15 double, total double")
    i = spark.createDataFrame([(1, 10.0)], "doc_id int, precio_total double")
    got = {r["doc_id"]: (r["items_vs_subtotal"], r["recomputed_vs_total"]) for r in finance.parser_checks(t, i).collect()}
    assert got == {1: (True, True), 2: (None, None)}


SAMPLE = """FACTURA ELECTRÓNICA
Andina Comercial
Av. Uno
RUC: 1790710319001
FACTURA No. 026-200-000021384
NÚMERO DE AUTORIZACIÓN
0807202501179071031900120262000000213845658032318
AMBIENTE: PRODUCCION
DESCRIPCION CANT P.UNIT P.TOTAL
JARABE PARA LA TOS 1 23.00 23.00
VITAMINA C FORTE 2 15.50 31.00
SUBTOTAL: $54.00
IVA 15%: $8.10
TOTAL: $62.10"""


def test_invoice_text(spark):
    df = spark.createDataFrame([(1, SAMPLE)], "doc_id bigint, text string")
    key = "0807202501179071031900120262000000213845658032318"
    assert extract.access_key(df).first()["clave"] == key
    assert extract.access_key_ocr(df).first()["clave"] == key
    assert extract.access_key_form(df).first()["clave"] == key
    h = extract.header_fields(df).first()
    assert (h["ruc"], h["razonSocial"]) == ("1790710319001", "FACTURA ELECTRONICA Andina Comercial Av. Uno")
    a = extract.invoice_amounts(df).first()
    assert (a["subtotal"], a["iva"], a["importeTotal"]) == (54.0, 8.1, 62.1)
    items = [(r["descripcion"], r["cantidad"], r["precio_unitario"], r["precio_total"]) for r in extract.items_from_text(df).orderBy("item_no").collect()]
    assert items == [("JARABE PARA LA TOS", 1.0, 23.0, 23.0), ("VITAMINA C FORTE", 2.0, 15.5, 31.0)]
    ocr = [(r["descripcion"], r["cantidad"], r["precio_total"]) for r in extract.items_from_ocr(df).orderBy("item_no").collect()]
    assert ocr == [("JARABE PARA LA TOS", 1.0, 23.0), ("VITAMINA C FORTE", 2.0, 31.0)]
    c = extract.capture_fields(df).first()
    assert (c["ruc"], c["invoice_number"]) == ("1790710319001", "026-200-000021384")
    i = extract.extract_ids(df).first()
    assert i["rucs"] == ["1790710319001"] and i["invalidos"] == []


def test_access_key_after_a_label_with_spaces(spark):
    key = "0807202501179071031900120262000000213845658032318"
    spaced = " ".join(key[i : i + 7] for i in range(0, 49, 7))
    df = spark.createDataFrame([(1, f"CLAVE DE ACCESO\n{spaced}\nfin"), (2, f"x {key[:48]} y"), (3, "nada")], "doc_id bigint, text string")
    assert [r["clave"] for r in extract.access_key(df).orderBy("doc_id").collect()] == [key, key[:48], None]


def test_items_from_capture_and_image(spark):
    df = spark.createDataFrame([(1, "10 1 2 JARABE 3,50 0,10 7,00\nTOTAL 9"), (2, "GALLETAS DULCES 2,50"), (3, "2 GALLETAS DULCES $5.00")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["descripcion"], r["cantidad"], r["precio_total"]) for r in extract.items_from_capture(df).where("doc_id < 3").orderBy("doc_id", "item_no").collect()]
    assert got[0] == (1, "JARABE", 2.0, 7.0) and got[1][:2] == (2, "GALLETAS DULCES")
    assert [(r["descripcion"], r["precio_total"]) for r in extract.items_from_image(df).where("doc_id = 3").collect()] == [("GALLETAS DULCES", 5.0)]


def test_fiscal_ids_and_xmp(spark):
    x = spark.createDataFrame([("a", '<f id="comprobante"><ruc>1790710319001</ruc><fecha>2025-07-08</fecha><c>' + "A" * 49 + "</c></f>")], "clave string, xml string")
    r = extract.xml_fiscal_ids(x).first()
    assert (r["ruc_emisor"], r["fecha_emision"], r["es_documento_sri"]) == ("1790710319001", "2025-07-08", True)
    body = b"junk<x:xmpmeta a='1'><xmp:CreateDate>2024-01-02</xmp:CreateDate><r xmp:CreatorTool=\"GIMP\"/></x:xmpmeta>end"
    d = spark.createDataFrame([("d", bytearray(body))], "doc_id string, content binary")
    assert extract.xmp_fields(d).first()["xmp"] == {"xmp_CreateDate": "2024-01-02", "CreatorTool": "GIMP"}


def test_date_rules(spark):
    rows = [
        (1, {"DateTimeOriginal": "2024:01:02 00:00:00", "DateTimeDigitized": "2024:01:01 00:00:00", "DateTime": "2030:01:01 00:00:00"}, {}),
        (2, {}, {"xmp_CreateDate": "2024-01-01"}),
    ]
    df = spark.createDataFrame(rows, "image_id int, exif map<string,string>, xmp map<string,string>")
    got = {r["image_id"]: r for r in images.date_consistency(df, "2026-01-01 00:00:00").collect()}
    assert got[1]["puntos"] == 50 and {"original_tras_digital", "futuras", "brechas"} <= set(got[1]["reglas"].split(","))
    # no record dates 15, single date 12
    assert got[2]["puntos"] == 27
    adv = images.date_consistency(df, "2026-01-01 00:00:00", advanced=True).where("image_id = 2").first()
    assert adv["puntos"] == 27


def test_lines_inside_clusters(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (1, 50.0, 50.0, 60.0, 50.0)], "image_id int, x1 double, y1 double, x2 double, y2 double")
    c = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 20.0, True)], "image_id int, cluster_id int, x0 double, y0 double, x1 double, y1 double, localizado boolean")
    r = images.line_angles(s, c).first()
    assert (r["lineas"], r["pares_paralelos"], r["en_clusters"]) == (2, 1, 0.5)


def test_results_do_not_depend_on_partitions(spark):
    words = spark.createDataFrame([(1, 1, i, float(i % 7), 10.0, float(i % 7 + 6), 20.0, "t") for i in range(40)], "doc_id bigint, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double, text string")
    one = boxes.word_overlaps(words.coalesce(1)).count()
    assert one == boxes.word_overlaps(words.repartition(13)).count() > 0


def test_signature_fields_far_from_the_range(spark):
    far = b" " * 30_000
    big = b"1 0 obj << /SubFilter /ETSI.CAdES.detached /Reason (R1) " + far + b"/ByteRange [0 10 20 30] /Contents <" + b"0A" * 15_000 + b"> " + far + b"/Name (N1) >> endobj"
    bare = b" 2 0 obj << /Type/Sig /ByteRange [0 1 2 3] /SubFilter /adbe.x >> endobj"
    df = spark.createDataFrame([(1, bytearray(big + bare)), (2, bytearray(b"/ByteRange [0 1 2 3] none"))], "doc_id bigint, content binary")
    got = [tuple(r) for r in pdfbytes.find_signatures(df).select("doc_id", "sig_no", "subfilter", "reason", "name", "con_contenido").orderBy("doc_id", "sig_no").collect()]
    assert got[0] == (1, 0, "ETSI.CAdES.detached", "R1", "N1", True)
    assert got[1] == (1, 1, "adbe.x", None, None, False)
    assert got[2] == (2, 0, None, None, None, False)
    assert not pdfbytes.find_signatures(df, distance=2000).where("sig_no = 0 AND con_contenido").count()


def test_keys_glued_to_other_digits(spark):
    key = "0807202501179071031900120262000000213845658032318"
    swapped = key.replace("4", "1")
    rows = [(1, "CLAVE DE ACCESO 98765432109" + key), (2, "Clave de Acceso: 98765432109" + key + "55"), (3, "9" * 30_000 + key + "x"), (4, "1" * 49), (5, "Clave de Acceso: 98765432109" + swapped), (6, "nada"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ocr = {r.doc_id: (r.clave, r.sin_valida) for r in extract.access_key_ocr(df.where("doc_id <> 5")).collect()}
    assert ocr == {1: (key, False), 2: (key, False), 3: (key, False), 4: (None, True), 6: (None, False), 7: (None, False)}
    form = {r.doc_id: (r.clave, r.sin_valida) for r in extract.access_key_form(df.where("doc_id NOT IN (3, 5)")).collect()}
    assert form[1] == form[2] == (key, False) and form[6] == form[7] == (None, False)


def test_amounts_beyond_the_usual_ranges_come_out(spark):
    text = "SUBTOTAL: 18000.00\nIVA: 6000.00\nDESCUENTO: 2000.00\nTOTAL A PAGAR: 20000.00"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    a = extract.invoice_amounts(df).first()
    assert (a["importeTotal"], a["subtotal"], a["iva"], a["descuento"]) == (20000.0, 18000.0, 6000.0, 2000.0)
    assert a["fuera_de_rango"] == ["importeTotal", "subtotal", "iva", "descuento"]
    limited = extract.invoice_amounts(df, extract.usual_ranges(extract.INVOICE_AMOUNTS)).first()
    assert (limited["importeTotal"], limited["subtotal"], limited["fuera_de_rango"]) == (None, None, [])
    e = extract.exhaustive_amounts(df).first()
    assert (e["total"], e["subtotal"], e["iva"]) == (20000.0, 18000.0, 6000.0)
    assert extract.exhaustive_amounts(df, extract.usual_ranges(extract.EXHAUSTIVE_AMOUNTS)).first()["iva"] is None
    last = spark.createDataFrame([(1, "GRACIAS\nVALOR TOTAL: 20000.00\nentrega 12.50")], "doc_id bigint, text string")
    for profile in ("posicion", "dirigida"):
        assert lines.tail_candidates(last, profile).first()["total"] == 20000.0
        assert lines.tail_candidates(last, profile, most=100.0).first()["total"] == 12.5


def test_items_of_any_price(spark):
    ocr = spark.createDataFrame([(1, "DESCRIPCION\n2 BOMBA HIDRAULICA 7500.00 15000.00\nSUBTOTAL 15000.00")], "doc_id bigint, text string")
    assert [(r["precio_unitario"], r["precio_total"]) for r in extract.items_from_ocr(ocr).collect()] == [(7500.0, 15000.0)]
    assert extract.items_from_ocr(ocr, most_unit=1000.0).count() == 0 and extract.items_from_ocr(ocr, most_total=10000.0).count() == 0
    photo = spark.createDataFrame([(1, "MOTOR ELECTRICO 2500.00")], "doc_id bigint, text string")
    assert {r["precio_total"] for r in extract.items_from_capture(photo).collect()} == {2500.0}
    assert extract.items_from_capture(photo, most=1000.0).count() == 0


def test_label_amount_reads_whole_numbers(spark):
    words = [(1, 1, 1, 0.0, 0.0, 9.0, 9.0, "VALOR TOTAL"), (1, 1, 2, 50.0, 0.0, 60.0, 9.0, "18000.00"), (2, 1, 1, 0.0, 0.0, 9.0, 9.0, "VALOR TOTAL"), (2, 1, 2, 50.0, 0.0, 60.0, 9.0, "234,567.89")]
    df = spark.createDataFrame(words, "doc_id bigint, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double, text string")
    assert {r["doc_id"]: r["valor_total"] for r in boxes.label_amounts(df).collect()} == {1: 18000.0, 2: 234567.89}


def test_key_inside_a_longer_run(spark):
    key = "0807202501179071031900120262000000213845658032318"
    texts = [(1, f"N {key}"), (2, f"77{key}5"), (3, "9" * 60), (4, "nothing"), (5, "1" * 49)]
    got = {r["doc_id"]: (r["clave"], r["sin_valida"]) for r in extract.access_key(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: (key, False), 2: (key, False), 3: (None, True), 4: (None, False), 5: ("1" * 49, False)}


def test_components_across_blocks(spark):
    snake = {(y, x) for y in range(0, 40, 2) for x in range(40)} | {(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)}  # one chain of over 800 tiles
    rows = [(1, y, x) for y, x in snake] + [(2, -3, -3), (2, -2, -3), (2, 500, 500)]
    df = spark.createDataFrame(rows, "image_id bigint, ty int, tx int")
    for block in (4, 128):
        got = {(r["image_id"], r["ty"], r["tx"]): r["component"] for r in graph.connected_tiles(df, block).collect()}
        assert len(got) == len(rows) and {c for k, c in got.items() if k[0] == 1} == {0}
        assert got[2, -3, -3] == got[2, -2, -3] == -3 * (1 << 31) - 3 and got[2, 500, 500] == 500 * (1 << 31) + 500


def test_matching_of_long_documents_and_sparse_numbers(spark):
    words = ["tornillo", "tornillo largo", "tuerca", "arandela plana", "arandela"]
    sri = [(1, i * 10**12 + 5, RNG.choice(words)) for i in range(400)] + [(2, 10**15, "tuerca")]
    pdf = [(1, i * 10**11 - 7, RNG.choice(words) + RNG.choice(["", " x"])) for i in range(390)] + [(2, -5, "tuercas"), (3, 1, "sola")]
    want, used = set(), set()
    for d, no, text in sorted(sri):
        best, score = None, -1.0
        for e, k, other in sorted(pdf):
            if e == d and (e, k) not in used:
                r = SequenceMatcher(None, text.upper(), other.upper()).ratio()
                if r > score:
                    best, score = k, r
        if best is not None and score >= 0.6:
            used.add((d, best))
            want.add((d, no, best, round(score, 9)))
    cols = "doc_id bigint, item_no bigint, descripcion string"
    got = recon.match_items(spark.createDataFrame(sri, cols), spark.createDataFrame(pdf, cols)).collect()
    assert {(r["doc_id"], r["sri_no"], r["pdf_no"], round(r["similitud"], 9)) for r in got} == want and len(got) == len(want)


def test_box_pairs_of_any_layout(spark):
    rows = [(1, i, RNG.uniform(-300, 300), RNG.uniform(-300, 300), RNG.choice([0, 1, 5, 40, 90, 700]), RNG.choice([0, 2, 30, 100, 5000])) for i in range(150)]
    rows += [(1, 900, -5e11, 0.0, 1e12, 3.0), (1, 901, 0.0, -1e15, 2.0, 2e15), (2, 1, 0.0, 0.0, 1.0, 1.0), (2, 2, 1e14, 1e14, 1e13, 1.0)]
    data = [(d, n, x, y, x + w, y + h) for d, n, x, y, w, h in rows]
    df = spark.createDataFrame([(d, 1, n, 0, *map(float, b)) for d, n, *b in data], "doc_id bigint, page int, block_no bigint, type int, x0 double, y0 double, x1 double, y1 double")
    want = {(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    for crowd in (boxes.CROWD, 3):
        got = [(r["doc_id"], r["a_block_no"], r["b_block_no"]) for r in boxes.box_pairs(df, df, ["doc_id"], crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        semi = boxes.box_semi(df, df, ["doc_id"], boxes.strictly_overlapping() & (boxes.F.col("a_block_no") != boxes.F.col("b_block_no")), crowd=crowd)
        strict = {(a[0], a[1]) for a in data for b in data if a[0] == b[0] and a[1] != b[1] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])}
        assert {(r["doc_id"], r["a_block_no"]) for r in semi.collect()} == strict
    words = df.select("doc_id", "page", boxes.F.col("block_no").alias("word_no"), "x0", "x1", boxes.F.lit(7.0).alias("y0"), boxes.F.lit("w").alias("text"))
    pairs = {(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and max(0.0, min(a[4], b[4]) - max(a[2], b[2])) > (a[4] - a[2] + b[4] - b[2]) / 2 * 0.5}
    assert {(r["doc_id"], r["a_word_no"], r["b_word_no"]) for r in boxes.word_overlaps(words, crowd=5).collect()} == pairs


def test_a_crowded_page_is_dealt_to_many_tasks(spark):
    n = 100_000
    at = spark.range(n).selectExpr("1L AS doc_id", "1 AS page", "id AS block_no", "0 AS type", "id * 1e-4 AS x0", "0.0D AS y0", "id * 1e-4 + 0.00005 AS x1", "9.0D AS y1")
    assert boxes.block_overlaps(at).collect() == []  # side by side inside one cell: nothing overlaps
    left, right, key = boxes._met_in_cells(at, at, ["doc_id", "page"], 64.0, boxes.CROWD)
    largest = right.groupBy(*key).count().agg({"count": "max"}).first()[0]
    assert largest < 1.2 * boxes.CROWD and left.groupBy(*key).count().count() == -(-n // boxes.CROWD)


def test_counted_medians_equal_numpy(spark):
    r = np.random.default_rng(5)
    groups = {
        (1, "a"): r.normal(size=501), (1, "b"): np.append(r.normal(size=400), 1e15), (2, "a"): np.repeat([3.0, 4.0], 10), (2, "b"): np.array([7.5]), (3, "a"): np.append(np.linspace(0, 1e-9, 3000), [1e12, -1e12]), (3, "b"): np.round(r.normal(size=1000), 1),
    }
    rows = [(k, m, float(v), int(c)) for (k, m), x in groups.items() for v, c in zip(*np.unique(x, return_counts=True))]
    df = spark.createDataFrame(rows, "image_id bigint, metric string, v double, c bigint")
    for bins in (4, 4096):
        got = {(x["image_id"], x["metric"]): x["median"] for x in skew.counted_medians(df, ["image_id", "metric"], bins).collect()}
        assert got == {k: float(np.median(x)) for k, x in groups.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_xml_is_parsed_once_and_metrics_read_twice(spark):
    from cotejo.plans import queries_boxes, queries_images

    for query in (queries_boxes.q_xml_invoice, queries_boxes.q_xml_items):
        assert _plan(query(spark, "/root/testdata/sf0.001")).count("from_xml(") == 1
    assert _plan(queries_images.q_mad_outliers(spark, "/root/testdata/sf0.001")).count("FileScan parquet") <= 2


def test_quadrants_of_an_image_without_its_last_tiles(spark):
    """Halves follow the size of the image, and the variance is the running one: a tie of the last digit falls as in the SQL."""
    rows = [(0, k // 10, k % 10, [RNG.randrange(256) for _ in range(8)]) for k in range(56)]

    def running(px):
        n, m, d = 0, 0.0, 0.0
        for v in px:
            n, gap = n + 1, v - m
            m += gap / n
            d += (v - m) * gap
        return d / n

    df = spark.createDataFrame(rows, "image_id bigint, ty int, tx int, px array<smallint>")
    parts = {}
    for _, ty, tx, px in rows:
        parts.setdefault((ty >= 5, tx >= 5), []).extend(px)
    v = [running(px) for px in parts.values()]
    assert tiles.quadrant_noise(df, grid=(10, 10)).first()["diferencia_maxima"] == max(v) - min(v)
    merged = tiles.quadrant_noise(df, grid=(10, 10), most=10).first()["diferencia_maxima"]
    assert math.isclose(merged, max(v) - min(v), rel_tol=1e-9)


def test_more_rows_make_more_tasks(spark, tmp_path):
    """Rows beyond the share of a task open another one, also above the number of cores."""
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/t")
    few = spark.read.parquet(f"{tmp_path}/t")
    assert skew.at_least_parallel(few).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert skew.at_least_parallel(few, rows=100).rdd.getNumPartitions() == 50
    enough = few.repartition(60)
    assert skew.at_least_parallel(enough, rows=100).rdd.getNumPartitions() == 60


def test_exhaustive_amounts_stay_in_the_row(spark):
    """Nothing is gathered by document, and a text without any amount has no candidates."""
    df = spark.createDataFrame([(1, "Subtotal: 10.00\nIVA 1.50\nValor total 11.50\nTotal 12,00"), (2, "nada"), (3, None)], "doc_id bigint, text string")
    out = extract.exhaustive_amounts(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[1]["subtotal"], got[1]["iva"], got[1]["total"]) == (10.0, 1.5, 11.5)
    assert [(got[k]["total"], got[k]["n_totales"], got[k]["totales_rango"]) for k in (2, 3)] == [(None, 0, None)] * 2


def test_uncrowded_pages_go_straight_into_the_join(spark):
    """Each side is shuffled once; a crowded page beside them is dealt and gives the same pairs."""
    rows = [(d, n, float(RNG.randrange(40)), float(RNG.randrange(40))) for d, size in ((1, 30), (2, 4), (3, 5)) for n in range(size)]
    df = spark.createDataFrame(rows, "doc_id int, no int, x0 double, y0 double").withColumns({"x1": F.col("x0") + 9, "y1": F.col("y0") + 9})
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and abs(a[2] - b[2]) <= 9 and abs(a[3] - b[3]) <= 9)
    plain, dealt = boxes.box_pairs(df, df, ["doc_id"], cell=16.0), boxes.box_pairs(df, df, ["doc_id"], cell=16.0, crowd=6)
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    for pairs in (plain, dealt):
        assert sorted((r["doc_id"], r["a_no"], r["b_no"]) for r in pairs.collect()) == want


def test_only_named_bands_are_searched_for_the_exclusion(spark):
    """Words are put in order only in bands that hold the second word; a pair split over two words still excludes."""
    cols = "doc_id int, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"
    words = spark.createDataFrame([(d, 1, n, 20.0 * n, 0.0, 20.0 * n + 9, 9.0, t) for d, ts in ((1, ["TOTAL", "SIN", "subsidio", "5.00"]), (2, ["TOTAL", "7.50"])) for n, t in enumerate(ts)], cols)
    labels = words.where("word_no = 0").select("doc_id", "page", F.col("word_no").alias("label_no"), "x0", "y0", "x1", "y1")
    text = spark.createDataFrame([(1, "VALOR TOTAL 9.00"), (2, "x")], "doc_id int, text string")
    out = boxes.label_amounts_in_band(words, labels, text)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["valor_total"], r["metodo"]) for r in out.collect()} == {1: (9.0, "busqueda_texto_fallback"), 2: (7.5, "busqueda_espacial")}


def test_items_from_ocr_reads_a_line_once(spark):
    df = spark.createDataFrame([(1, "TOTAL 9\nDETALLE\nA 9.99\nCafé molido 2 1.50 3.00\n... 3 2.00 7.00 6.00\nCAJA TOTAL 1.00 1.00\nzzz 1 1.00 1.00"), (2, "sin tabla 1 1.00 1.00"), (3, None), (4, "DETALLE")], "doc_id bigint, text string")
    items = extract.items_from_ocr(df)
    got = [tuple(r) for r in items.orderBy("doc_id", "item_no").collect()]
    assert got == [(1, 0, "Cafe molido", 2.0, 1.5, 3.0), (1, 1, "Producto 3", 3.0, 2.0, 6.0)]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("translate(") == 1


def test_settle_items_says_what_the_three_operators_say(spark, monkeypatch):
    words = ["pan", "leche entera", "leche", "arroz blanco", "arroz", "azucar"]
    row = lambda d, i: (d, i * 7, RNG.choice(words), float(RNG.randint(1, 3)), RNG.choice([1.0, 1.5, None]), 2.0)
    cols = "doc_id bigint, item_no bigint, descripcion string, cantidad double, precio_unitario double, precio_total double"
    a, b = (spark.createDataFrame([row(d, i) for d in docs for i in range(RNG.randint(1, 9))] + [(20, 3, "pan", 1.0, 1.0, q), (20, 3, "pan", 2.0, 1.0, q)], cols) for docs, q in ((range(6), 1.0), (range(2, 8), 2.0)))
    for chunk in (256, 4):
        monkeypatch.setattr(recon, "CHUNK", chunk)
        settled = recon.settle_items(a, b)
        assert settled._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 or chunk == 4
        flags = ["dif_cantidad", "dif_precio_unitario", "dif_precio_total"]
        rows = lambda df, *names: sorted(map(repr, map(tuple, df.select("doc_id", *names).collect())))
        matches = recon.match_items(a, b)
        assert rows(recon.differing(settled), "sri_no", "pdf_no", *flags) == rows(recon.diff_items(matches, a, b), "sri_no", "pdf_no", *flags)
        loose = recon.unmatched_items(matches, a, b)
        for label, no, other in (("no_encontrado_en_pdf", "sri_no", "pdf_no"), ("no_encontrado_en_sri", "pdf_no", "sri_no")):
            assert rows(settled.where(f"{other} is null"), no) == rows(loose.where(f"match = '{label}'"), "item_no")


def _odd_texts(spark):
    base = ["total a pagar 10", "total a pagar 11", "iva 15%", "otra cosa", "otra casa", "x", "a" + " " * 12 + "b", "\x07 campana"]
    docs = [(d, "\n".join(RNG.choice(base) + RNG.choice(["", "!", " ", "\r"]) for _ in range(n))) for d, n in enumerate((25, 3, 1, 40, 0, 30))]
    docs += [(6, None), (7, " \n\n"), (8, "factura 100\nfactura 101"), (8, "otro texto\nfactura 109"), (None, "uno dos\nuno dos!")]
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)


def test_lines_of_two_texts_with_one_id_keep_their_own_ratio(spark):
    split = lines.split_lines(_odd_texts(spark)).where("doc_id = 8")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = [(0, 1, ratio("factura 100", "factura 101")), (0, 1, ratio("factura 100", "factura 109"))]
    assert sorted((r.i, r.j, r.ratio) for r in lines.similar_lines(split).collect()) == sorted(want)


def test_text_overlap_in_texts_equals_that_of_lines(spark, monkeypatch):
    df = _odd_texts(spark)
    split = lines.split_lines(df)
    want = sorted(map(tuple, lines.text_overlap(split, lines.similar_lines(split)).collect()))
    assert sorted(map(tuple, lines.text_overlap_in_texts(df).collect())) == want and len(want) == 6
    # texts of more than a few lines in several parts, and answers in small pieces
    monkeypatch.setattr(lines, "LONG_TEXT", 4)
    monkeypatch.setattr(lines, "ANSWER", 2)
    assert sorted(map(tuple, lines.text_overlap_in_texts(df).collect())) == want


def test_similar_lines_in_texts_equal_those_of_lines(spark, monkeypatch):
    df = _odd_texts(spark)
    want = sorted((r.doc_id, r.i, r.j, r.ratio) for r in lines.similar_lines(lines.split_lines(df)).collect())
    assert sorted(map(tuple, lines.similar_lines_in_texts(df).collect())) == want and len(want) > 100
    monkeypatch.setattr(lines, "LONG_TEXT", 4)
    monkeypatch.setattr(lines, "ANSWER", 2)
    assert sorted(map(tuple, lines.similar_lines_in_texts(df).collect())) == want


def _greedy_boxes(data):
    """Boxes (image_id, box_no, x0, y0, x1, y1) that the greedy loop keeps, image by image."""
    keep = set()
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    for image in {b[0] for b in data}:
        kept = []
        for b in sorted((b for b in data if b[0] == image), key=lambda b: (b[3] + b[2] * 0.1, b[1])):
            inter = [max(0.0, min(k[4], b[4]) - max(k[2], b[2])) * max(0.0, min(k[5], b[5]) - max(k[3], b[3])) for k in kept]
            if not any(i > 0.2 * (area(k) + area(b) - i + 1e-6) for i, k in zip(inter, kept)):
                kept.append(b)
        keep |= {b[:2] for b in kept}
    return keep


def test_merge_boxes_in_rows_and_in_rounds(spark):
    cols = "image_id bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double"
    data = []
    # small ones, one with tall and wide boxes, one far off with negative places
    for image, n, far, size in ((1, 6, 30, 20), (2, 90, 200, 40), (3, 60, 400, 300), (4, 70, -5000, 800), (5, 1, 10, 10)):
        for i in range(n):
            x, y = RNG.uniform(min(0, far), max(0, far)), float(RNG.randint(min(0, far), max(0, far)))
            data.append((image, i, x, y, x + RNG.uniform(1, size), y + RNG.uniform(1, size)))
    want = _greedy_boxes(data)
    odd = [(6, 0, None, 1.0, 5.0, 5.0), (6, 1, 0.0, 0.0, 9.0, 9.0), (6, 2, 0.5, 0.5, 9.0, 9.0), (6, 3, 20.0, 0.0, 25.0, None), (6, 4, 20.0, 0.0, 25.0, 4.0), (None, 0, 0.0, 0.0, 1.0, 1.0)]
    want |= {(6, 0), (6, 1), (6, 3), (6, 4)}
    df = spark.createDataFrame(data + odd, cols).repartition(3)
    for crowd in (4096, 65, 5):
        got = boxes.merge_boxes(df, crowd=crowd)
        assert got.columns == df.columns and sorted((r.image_id, r.box_no) for r in got.collect()) == sorted(want)
    # every box in two pieces
    halves = df.withColumn("x1", F.col("x0")).unionByName(df.withColumn("x0", F.col("x1"))).where("image_id < 6")
    for crowd in (4096, 65):
        assert {(r.image_id, r.box_no) for r in boxes.merge_boxes(halves, crowd=crowd, in_pieces=True).collect()} == {k for k in want if k[0] < 6}
