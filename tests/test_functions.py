import datetime as dt
import random

from pyspark.sql import functions as F

from cotejo.functions import dates, hashes, ids, numbers, text
from cotejo.functions.similarity import seq_ratio

KEY = "0807202501179071031900120262000000213845658032318"


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def check_digit(base):
    total = sum(int(d) * (2 + i % 6) for i, d in enumerate(reversed(base)))
    return {11: 0, 10: 1}.get(11 - total % 11, 11 - total % 11)


def test_to_float(spark):
    assert column(spark, ["1,5", " 2.50 ", "1.234,56", "", "abc", "5d", None, "-3"], numbers.to_float) == [1.5, 2.5, None, None, None, None, None, -3.0]


def test_normalize_decimal(spark):
    values = ["1.234,56", "1,234.56", "12,5", "1.234.567", "7"]
    assert column(spark, values, numbers.normalize_decimal) == [1234.56, 1234.56, 12.5, None, 7.0]
    assert column(spark, values, lambda c: numbers.normalize_decimal(c, "xml")) == [1234.56, 1234.56, 12.5, 1234567.0, 7.0]


def test_norm_and_clean_amount(spark):
    assert column(spark, ["1.234,56", "1,234.56", "12"], numbers.norm_amount) == [1234.56, 1234.56, 12.0]
    assert column(spark, ["1,234", "10,50", "1,234.50"], lambda c: numbers.clean_amount(c)) == [1234.0, 10.5, 1234.5]
    assert column(spark, ["$ 1.234,56", "9,9", "x"], lambda c: numbers.clean_amount(c, "mixed")) == [1234.56, 9.9, None]


def test_first_money_keeps_the_order_of_shapes(spark):
    # grouped thousands do not parse, so the second shape supplies the value
    assert column(spark, ["TOTAL 12,50", "1.234,56", "-5 x 3", "nada"], numbers.first_money) == [12.5, 1.23, 3.0, None]


def test_key_check_and_parts(spark):
    for digit in range(49):
        changed = KEY[:digit] + str((int(KEY[digit]) + 1) % 10) + KEY[digit + 1 :]
        assert changed != KEY
    changes = [KEY[:i] + str((int(KEY[i]) + k) % 10) + KEY[i + 1 :] for i in range(49) for k in range(1, 10)]
    assert column(spark, [KEY], ids.key_valid) == [True]
    assert not any(column(spark, changes, ids.key_valid))
    p = column(spark, [KEY], ids.key_parts)[0]
    assert (p["codDoc"], p["ruc"], p["ambiente"], p["serie"], p["secuencial"], p["codigoNumerico"], p["tipoEmision"], p["dv"]) == (
        "01", "1790710319001", "2", "026200", "000021384", "56580323", "1", "8",
    )
    reasons = [r["reason"] for r in column(spark, [KEY, KEY[:48], "x" * 49, changes[0]], ids.key_check)]
    assert reasons == ["valida", "longitud", "no_numerica", "digito_verificador"]


def test_check_digit_against_plain_python(spark):
    rng = random.Random(1)
    bases = ["".join(rng.choice("0123456789") for _ in range(48)) for _ in range(200)]
    assert column(spark, bases, ids.check_digit_mod11) == [check_digit(b) for b in bases]


def test_key_repair(spark):
    # a 1 read as 4 and a 7 read as 4 are undone; 48 digits are completed
    one, seven = KEY.index("1"), KEY.index("7")
    wrong = [KEY[:one] + "4" + KEY[one + 1 :], KEY[:seven] + "4" + KEY[seven + 1 :]]
    fixed = column(spark, [*wrong, KEY[:48], KEY, "12"], ids.repair_key)
    assert all(check_digit(k[:48]) == int(k[48]) for k in fixed[:4])
    assert fixed[2] == KEY and fixed[3] == KEY and fixed[4] == "12"
    assert column(spark, [KEY.replace("0", "O")], ids.repair_key_swaps) == [KEY]


def test_personal_and_taxpayer_numbers(spark):
    assert column(spark, ["1790710319001", "1234567890123", "1710034065001"], ids.ruc_ok)[:2] == [True, False]
    assert column(spark, ["1234567890", "1710034065", "9910034065", "x"], ids.cedula_ok) == [False, True, False, False]


def test_dates(spark):
    assert column(spark, ["D:20250708195813-05'00'", "2025", "D:20251399", "", "abc"], dates.pdf_date) == [
        dt.datetime(2025, 7, 8, 19, 58, 13), dt.datetime(2025, 1, 1), dt.datetime(2025, 12, 28), None, None,
    ]
    assert column(spark, ["08/07/2025", "8-7-25", "31/02/2025", "x"], dates.issue_date) == [dt.date(2025, 7, 8), dt.date(2025, 7, 8), None, None]
    assert column(spark, ["2024:01:02 03:04:05", "2024-01-02", "2024-01-02T03:04:05-05:00", "2024-01-02T03:04:05.25Z", "2/1/2024"], dates.meta_date) == [
        dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5), None,
    ]


def test_text_normalisation(spark):
    assert column(spark, ["  Clínica  Ñandú (S.A.) ", None], text.norm_desc) == ["CLINICA NANDU S.A.", ""]
    assert column(spark, ["<![CDATA[ <a/> ]]>", "&lt;a b=&quot;1&quot;/&gt;", "﻿<a/>", "<a>x</a>"], text.clean_xml) == ["<a/>", '<a b="1"/>', "<a/>", "<a>x</a>"]
    assert column(spark, ["O1lZSB"], text.ocr_digits) == ["011258"]
    assert column(spark, ["a​b﻿"], text.strip_zero_width) == ["ab"]


def test_hash_distance(spark):
    values = [("0" * 16, "f" * 16, 64), ("8000000000000001", "0000000000000000", 2), ("ffffffff00000000", "ffffffff0000000f", 4)]
    df = spark.createDataFrame(values, "a string, b string, d int")
    assert df.where(hashes.hamming64(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_subsequence_bounds_the_ratio():
    from difflib import SequenceMatcher

    from cotejo.functions.similarity import common_subsequence

    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]
        matched = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert matched <= table[-1][-1]


def test_common_subsequences_in_one_pass():
    from cotejo.functions.similarity import CommonSubsequences, common_subsequence

    rng = random.Random(5)
    for letters in ("ab", "abcdeñ€\U0001f600", "a\n"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(12)]
        packed = CommonSubsequences(texts)
        for k in range(1, len(texts)):
            want = [common_subsequence(a, texts[k]) for a in texts[:k]]
            assert packed.lengths(k, k).tolist() == want
            reach = [i for i, n in enumerate(want) if 2.0 * n / max(1, len(texts[i]) + len(texts[k])) >= 0.7]
            assert packed.near(k, k, 0.7).tolist() == reach


def test_sequence_ratio_is_not_symmetric_and_exact(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for _ in range(100)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", seq_ratio(F.col("a"), F.col("b")).alias("r"))
    assert all(r["r"] == SequenceMatcher(None, r["a"], r["b"]).ratio() for r in df.collect())


def test_near_pairs_are_those_the_common_subsequence_allows(monkeypatch):
    from cotejo.functions import similarity

    rng = random.Random(11)
    texts = ["".join(rng.choice("abñ\U0001f600") for _ in range(rng.choice((0, 3, 9, 40)))) for _ in range(60)]
    texts = list(dict.fromkeys([*texts, *(t[:-1] + "é" for t in texts if t), "x" * 300, "x" * 299 + "\n"]))
    hope = lambda a, b: 2.0 * similarity.common_subsequence(a, b) / max(1, len(a) + len(b))
    want = {(i, j) for i in range(len(texts)) for j in range(i) if hope(texts[i], texts[j]) >= 0.7}
    # small blocks, and few letters at a time
    for block, letters, cells in ((64, 65_536, 4_000_000), (3, 65_536, 1), (64, 50, 200)):
        monkeypatch.setattr(similarity, "_BLOCK", block)
        monkeypatch.setattr(similarity, "_BLOCK_LETTERS", letters)
        monkeypatch.setattr(similarity, "_CELLS", cells)
        for parts in (1, 4):
            found = [(max(p), min(p)) for part in range(parts) for p in similarity.near_pairs(texts, 0.7, part, parts)]
            assert sorted(found) == sorted(want)
