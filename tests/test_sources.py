import base64
import json

import pytest
from pyspark.sql import functions as F

from cotejo.operators import claims as claim_ops, config_tables, pdfbytes, signatures
from cotejo.sources import claims, config, documents, invoice_xml

CLAIMS = {
    "reclamos": [
        {"id_reclamo": f"CLM-000-00{i}", "fecha_envio": "19/08/2024", "proveedor": {"nombre": n, "tipo_servicio": "x"}, "estado": s, "monto_solicitado": a, "monto_aprobado": b, "moneda": "$", "acciones": {"ver": True, "subir": u}}
        for i, (n, s, a, b, u) in enumerate(
            [("Hospital San Juan", "Aprobado", 450.0, 405.0, False), ("Clínica Dental Sonrisa", "En Revisión", 280.0, None, False), ("Laboratorio Central", "En Revisión", 125.0, None, True),
             ("Farmacia del Centro", "En Revisión", 89.5, None, False), ("Centro de Fisioterapia", "En Revisión", 320.0, None, True)], 1)
    ]
}


@pytest.fixture
def claim_file(tmp_path):
    p = tmp_path / "claims.json"
    p.write_text(json.dumps(CLAIMS, indent=1), encoding="utf-8")
    return str(p)


def test_claims_file(spark, claim_file, tmp_path):
    c = claims.read_claims(spark, claim_file)
    s = claim_ops.claim_stats(c).first()
    assert (s["total_reclamos"], s["por_estado"], s["total_solicitado"], s["total_aprobado"]) == (5, {"Aprobado": 1, "En Revisión": 4}, 1264.5, 405.0)
    assert claim_ops.next_claim_id(c).first()["next_id"] == "CLM-000-006"
    assert claims.read_claim_metadata(spark, claim_file).first()["estados_disponibles"] == claims.CLAIM_STATES
    assert claim_ops.filter_claims(c, "en revisión", "CENTRO").count() == 2
    target = claims.write_claims(c, str(tmp_path / "out"), "1")
    assert spark.read.parquet(target).count() == 5
    assert claim_ops.next_claim_id(c.where("false")).first()["next_id"] == "CLM-000-001"


def test_claim_update(spark, claim_file):
    c = claims.read_claims(spark, claim_file)
    p = spark.createDataFrame([("CLM-000-003", "Aprobado", 100.0), ("CLM-000-002", "Rechazado", None)], "id_reclamo string, estado string, monto_aprobado double")
    got = {r["id_reclamo"]: (r["estado"], r["monto_aprobado"], r["acciones"]["subir"]) for r in claim_ops.update_claims(c, p).collect()}
    assert got["CLM-000-003"] == ("Aprobado", 100.0, False) and got["CLM-000-002"] == ("Rechazado", None, True) and got["CLM-000-005"][2]


def test_config_files(spark, tmp_path):
    w, lv, ds = tmp_path / "w.json", tmp_path / "l.json", tmp_path / "d.json"
    w.write_text(json.dumps({"a": 3, "b": -4}))
    lv.write_text(json.dumps({"bajo": [0, 25], "medio": [26, 42], "alto": [43, 100]}))
    ds.write_text(json.dumps({"a": {"valor": 1, "descripcion": "d", "explicacion": "e"}}))
    weights = config.read_weights(spark, str(w))
    assert config_tables.weight_totals(weights).first().asDict() == {"total_criterios": 2, "peso_maximo_positivo": 3, "peso_maximo_negativo": -4}
    detailed = {r["check_key"]: r["descripcion"] for r in config_tables.weights_detailed(weights, config.read_descriptions(spark, str(ds))).collect()}
    assert detailed == {"a": "d", "b": "Sin descripción"}
    levels = config.read_levels(spark, str(lv))
    assert [(r["level_no"], r["level"], r["lo"], r["hi"]) for r in levels.orderBy("level_no").collect()] == [(0, "bajo", 0, 25), (1, "medio", 26, 42), (2, "alto", 43, 100)]
    assert config_tables.validate_levels(levels).count() == 0
    bad = spark.createDataFrame([("a", "1.5"), ("c", "1")], "check_key string, weight string")
    errors = {r["check_key"]: r["error"] for r in config_tables.validate_weights(bad, weights).collect()}
    assert errors == {"a": "no_entero", "b": "falta", "c": "desconocida"}
    with pytest.raises(ValueError):
        config_tables.replace_config(bad, config_tables.validate_weights(bad, weights), str(tmp_path / "no"))
    config_tables.replace_config(levels, config_tables.validate_levels(levels), str(tmp_path / "yes"))
    assert config_tables.validate_levels(config_tables.reset_levels(spark)).count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    docs = documents.scan_files(spark, str(tmp_path))
    assert docs.select(documents.file_kind(F.col("content"))).first()[0] == "PDF"
    df = spark.createDataFrame([("1", "n", base64.b64encode(b"<?xml ?><factura/>").decode()), ("2", "n", "###")], "doc_id string, name string, body string")
    raw = documents.decode_base64(df)
    assert [r["doc_id"] for r in documents.accept_docs(raw).collect()] == ["1"]
    assert documents.reject_docs(raw).first()["reason"] == "base64_invalido"
    assert documents.accept_docs(raw).select(documents.document_branch(F.col("content"))).first()[0] == "xml"
    documents.write_traces(spark.createDataFrame([("1" * 49, "x")], "clave string, r string"), str(tmp_path / "t"))
    assert (tmp_path / "t" / f"key_prefix={'1' * 10}").exists()
    documents.export_results(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_authorization_answers(spark):
    rows = [
        ("one", json.dumps({"autorizaciones": {"autorizacion": {"estado": "AUTORIZADO", "comprobante": "<a/>"}}})),
        ("late", json.dumps({"autorizaciones": {"autorizacion": [{"estado": "RECHAZADO", "comprobante": "<r/>"}, {"estado": "vigente", "comprobante": "<v/>"}]}})),
        ("no", json.dumps({"autorizaciones": {"autorizacion": [{"estado": "NO AUTORIZADO", "comprobante": "<n/>"}]}})),
        ("none", json.dumps({"autorizaciones": None})),
    ]
    parsed = invoice_xml.parse_auth_json(spark.createDataFrame(rows, "clave string, respuesta string"))
    got = {r["clave"]: (r["autorizado"], r["estado"], r["xml"]) for r in invoice_xml.normalize_auth(parsed).collect()}
    assert got == {"one": (True, "AUTORIZADO", "<a/>"), "late": (True, "RECHAZADO", "<v/>"), "no": (False, "NO AUTORIZADO", "<n/>"), "none": (False, "SIN_ESTADO", None)}


def test_invoice_xml_fields(spark):
    xml = """<factura id="comprobante"><infoTributaria><ruc> 1790710319001 </ruc></infoTributaria><infoFactura><importeTotal>62,10</importeTotal>
    <pagos><pago><formaPago>01</formaPago><total>62.10</total></pago></pagos></infoFactura>
    <detalles><detalle><descripcion>Uno</descripcion><cantidad>2</cantidad></detalle></detalles>
    <infoAdicional><campoAdicional nombre="a">1</campoAdicional><campoAdicional nombre="a">2</campoAdicional></infoAdicional></factura>"""
    escaped = xml.replace("<", "&lt;").replace(">", "&gt;")
    df = invoice_xml.read_invoice_xml(spark.createDataFrame([("k", xml), ("e", escaped), ("bad", "no xml")], "clave string, xml string"))
    got = {r["clave"]: r for r in df.collect()}
    for k in ("k", "e"):
        assert got[k]["infoTributaria"]["ruc"] == "1790710319001" and got[k]["infoFactura"]["importeTotal"] == 62.1
        assert got[k]["infoAdicional"] == {"a": "2"} and got[k]["infoFactura"]["pagos"][0]["total"] == 62.1
    assert not got["bad"]["parsed"]
    assert invoice_xml.xml_items(df.where("clave = 'k'")).first()["cantidad"] == 2.0


def test_certificates(spark):
    rows = [("1", "2024-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "Ana"), ("2", "2020-01-01", "2021-01-01", "Ana"), ("3", "", "", "Ana"), ("4", "", "", "")]
    df = signatures.cert_ok(spark.createDataFrame(rows, "id string, not_before string, not_after string, subject string"), "2025-01-01")
    assert [r["valido"] for r in df.orderBy("id").collect()] == [True, False, True, False]


def test_literal_producer_rule(spark):
    m = spark.createDataFrame([("1", "p", "", "x"), ("2", None, None, None)], "doc_id string, producer string, creator string, author string")
    assert [r[1] for r in pdfbytes.producer_ok(m, literal=True).orderBy("doc_id").collect()] == [False, True]
