"""Text, statistics and personal-data functions against values worked out by hand or in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from assaykit.functions import schema as schemas
from assaykit.functions import pii, stats, text
from assaykit.operators import evaluators as ev


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


@pytest.mark.parametrize(
    ("reply", "want"),
    [("Yes.", True), ("  **No**, because", False), ("It is a yes", True), ("no... well, yes", False), ("Yesterday", None), ("maybe", None), ("", None), (None, None), ("both yes and no", None), ("NO", False)],
)
def test_verdict(spark, reply, want):
    assert one(spark, text.verdict(F.lit(reply).cast("string"))) is want


def test_white_space(spark):
    assert one(spark, text.strip(F.lit("\u00a0 a b\u2003\n"))) == "a b"
    assert one(spark, text.words(F.lit(" a\u00a0b \t c "))) == ["a", "b", "c"]
    assert one(spark, text.words(F.lit(""))) == []
    assert one(spark, text.folded(F.lit("Straße"))) == "strasse"
    assert one(spark, text.zero_width(F.lit("abc"))) == "a\u200bb\u200bc"
    assert one(spark, text.refusal(F.lit("I cannot help"))) is True
    assert one(spark, text.refusal(F.lit("I cannot help" + " x" * 200))) is False
    assert one(spark, text.json_path(F.lit('{"a": [{"b": 3}]}'), "a.0.b")) == "3"


CHECKS = [
    (pii.luhn, "4111 1111 1111 1111", True), (pii.luhn, "4111 1111 1111 1112", False), (pii.luhn, "0000", False),
    (pii.verhoeff, "2363", True), (pii.verhoeff, "2364", False),
    (pii.iban, "GB82 WEST 1234 5698 7654 32", True), (pii.iban, "GB82 WEST 1234 5698 7654 33", False), (pii.iban, "DE89370400440532013000", True),
    (pii.nhs, "943 476 5919", True), (pii.nhs, "943 476 5918", False),
    (pii.ssn, "219-09-9999", True), (pii.ssn, "000-12-3456", False), (pii.ssn, "666-12-3456", False), (pii.ssn, "123-45-6789", False), (pii.ssn, "912-12-3456", False), (pii.ssn, "219-00-9999", False),
    (pii.pan, "ABCPE1234F", True), (pii.pan, "ABCDE1234F", False),
    (pii.gstin, "27AAPFU0939F1ZV", True), (pii.gstin, "27AAPFU0939F1XV", False),
]


@pytest.mark.parametrize(("check", "value", "want"), CHECKS)
def test_checksums(spark, check, value, want):
    assert one(spark, check(F.lit(value))) is want


HITS = [
    ("email", "write to a.b@c.org now", "nobody at example"), ("phone_us", "call 212-555-0123", "call 112-555-0123"), ("ip_address", "at 10.0.0.255", "at 10.0.0.256.1x"),
    ("medical_record_number", "MRN: 12345", "MRN: 12"), ("patient_name", "Dr. Jane Doe came", "patient was here"), ("age_over_89", "aged 93", "aged 43"), ("us_zip", "94103 is my ZIP", "94103 is it"),
    ("eu_vat", "VAT DE123456789", "vat de123456789"), ("uk_ni_number", "AB123456C", "DB123456C"), ("es_dni", "12345678Z", "1234567Z"), ("nl_bsn", "BSN: 123456789", "123456789"), ("pl_pesel", "44051401458 is my PESEL", "44051401458 alone"),
    ("bank_account", "acct 12345678", "acct 1234"), ("ca_drivers_license", "CA DL A1234567", "CA DL 1234567"), ("pan", "ABCPE1234F", "ABCDE1234F"), ("ifsc", "HDFC0001234", "HDFC1001234"), ("voter_id", "ABC1234567", "AB1234567"),
    ("fr_nir", "180017511203401", "380017511203401"), ("fi_hetu", "131052-308T", "131052308T"), ("in_vehicle_reg", "KA 01 AB 1234", "KA"),
]


@pytest.mark.parametrize(("name", "hit", "miss"), HITS)
def test_patterns(spark, name, hit, miss):
    pattern = pii.patterns()[name]
    assert len(one(spark, pii.found(F.lit(hit), name, pattern))) == 1
    assert one(spark, pii.found(F.lit(miss), name, pattern)) == []


def test_jurisdictions_and_extra_patterns(spark):
    assert set(pii.patterns("pipeda")) == set(pii.BASE)
    assert len(pii.patterns()) == 11 + 13 + 14 + 2 + 10
    assert "own" in pii.patterns(extra={"own": r"\d", "broken": "("}) and "broken" not in pii.patterns(extra={"broken": "("})
    with pytest.raises(ValueError, match="jurisdiction"):
        pii.patterns("mars")
    assert one(spark, pii.found(F.lit("Mr. Ann Lee and Dr. Bo"), "patient_name", pii.HIPAA["patient_name"])) == ["Ann Lee", "Bo"]


def test_span_scanner_and_redaction(spark):
    key = "AKIA" + "A1B2" * 4
    said = f"mail a@b.co, key {key}, card 4111-1111-1111-1111, ssn 219-09-9999"
    assert [(k, said[s:e]) for _, k, s, e, _ in pii.scan_text(said)] == [("email", "a@b.co"), ("aws_access_key", key), ("credit_card", "4111-1111-1111-1111"), ("us_ssn", "219-09-9999")]
    assert pii.redact_text(said) == "mail [REDACTED:email], key [REDACTED:aws_access_key], card [REDACTED:credit_card], ssn [REDACTED:us_ssn]"
    assert pii.redact_text(None) is None and pii.scan_text(None) == []
    df = spark.createDataFrame([(said,), (None,), ("clean",)], "text string")
    assert {r.label: r.n for r in pii.label_counts(df, "text").collect()} == {"email": 1, "aws_access_key": 1, "credit_card": 1, "us_ssn": 1}
    with pytest.raises(Exception, match="personal data"):
        pii.sanitised(df, "text", "strict").collect()
    assert pii.sanitised(df, "text", "allow") is df


def test_closed_forms(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert one(spark, low) == pytest.approx(stats.wilson_value(8, 10)[0]) and one(spark, high) == pytest.approx(0.943, abs=1e-3)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[1]) == 1.0
    assert [one(spark, stats.detectable(F.lit(n), F.lit(0.7))) for n in (50, 200, 500, 0)] == [0.2568, 0.1284, 0.0812, 1.0]
    assert [one(spark, stats.sample_size(F.lit(d), F.lit(0.7))) for d in (0.05, 0.10)] == [1248, 291]
    for z in (0.0, 0.5, 1.0, 1.96, 3.0):
        assert one(spark, stats.tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), abs=3e-7)
    assert one(spark, stats.discordance_p(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, stats.discordance(F.lit(3), F.lit(3))) == pytest.approx(1 / 6)
    assert one(spark, stats.two_rates_p(F.lit(0.5), F.lit(0), F.lit(0.5), F.lit(9))) == 1.0
    assert one(spark, stats.two_rates_z(F.lit(0.5), F.lit(100), F.lit(0.7), F.lit(100))) == pytest.approx(2.8868, abs=1e-4)


@pytest.mark.parametrize(("n", "c", "k"), [(5, 2, 1), (5, 2, 3), (5, 0, 2), (5, 5, 5), (10, 7, 4), (3, 1, 4)])
def test_pass_k(spark, n, c, k):
    a, h = one(spark, stats.any_of_k(F.lit(n), F.lit(c), k)), one(spark, stats.all_of_k(F.lit(n), F.lit(c), k))
    if k > n:
        assert a is None and h is None
    else:
        assert a == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k)) and h == pytest.approx(math.comb(c, k) / math.comb(n, k))


def test_resampling_is_deterministic_and_honest():
    scores = [0.1, 0.9, 0.5, 0.7]
    assert stats.bootstrap_mean(scores) == stats.bootstrap_mean(scores)
    low, high = stats.bootstrap_mean(scores)
    assert low <= sum(scores) / 4 <= high
    assert stats.bootstrap_mean([]) == (0.0, 1.0) and stats.bootstrap_mean([0.3]) == (0.3, 0.3)
    assert stats.cluster_bootstrap([1.0] * 10)[0] < 1.0
    low, high = stats.credible(80, 100)
    assert 0.70 < low < 0.73 and 0.85 < high < 0.88
    assert stats.credible(0, 0) == (0.0, 1.0) and stats.credible(150, 200)[0] == pytest.approx(0.686, abs=2e-3)


def test_text_metrics():
    assert ev.bleu_score("a b c d", "a b c d") == 1.0 and ev.bleu_score("a b", "c d") == 0.0 and ev.bleu_score("", "a") == 0.0
    assert ev.rouge_l_score("the cat sat", "the cat lay") == round(2 * 2 / 6, 4)
    assert ev.rouge_l_score("a b c d e", "b x d a e") == round(2 * 3 / 10, 4)
    assert ev.chrf_score("same", "same") == 1.0 and ev.chrf_score("abc", "") == 0.0 and 0 < ev.chrf_score("kitten", "sitting") < 1
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x"]}}, "additionalProperties": False}
    assert ev.schema_errors({"a": 2}, schema) == [] and len(ev.schema_errors({"b": "y", "c": 1}, schema)) == 3
    assert ev.schema_errors(True, {"type": "integer"}) and not ev.schema_errors(2.0, {"type": "integer"})
    assert ev.schema_errors([1, 1], {"uniqueItems": True}) and ev.schema_errors("ab", {"pattern": "^c"}) and ev.schema_errors(3, {"anyOf": [{"type": "string"}, {"maximum": 2}]})


def _bad(schema, *values, formats=False):
    return [len(schemas.errors(v, schema, formats)) for v in values]


def test_schema_references():
    tree = {"definitions": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/definitions/node"}}}, "additionalProperties": False}}, "$ref": "#/definitions/node"}
    deep = {"v": 0}
    for i in range(200):
        deep = {"v": i, "kids": [deep]}
    assert _bad(tree, {"v": 1}, {"v": 1, "kids": [{"v": "x"}, {}]}, {"kids": [{"v": 1, "w": 0}]}, deep) == [0, 2, 2, 0]
    assert _bad({"items": {"$ref": "#"}, "type": "array"}, [[], [[]]], [[], 1]) == [0, 1]
    assert _bad({"definitions": {"a/b~c": {"type": "array"}, "named": {"$id": "#here", "type": "string"}}, "properties": {"x": {"$ref": "#/definitions/a~1b~0c"}, "y": {"$ref": "#here"}}}, {"x": {}}, {"x": []}, {"y": 1}, {"y": "s"}) == [1, 0, 1, 0]
    assert _bad({"$ref": "#/definitions/s", "minLength": 9, "definitions": {"s": {"type": "string"}}}, "short") == [0]
    for broken in ({"$ref": "#/definitions/none"}, {"$ref": "http://x/y"}, {"$ref": "#"}, {"definitions": {"a": {"$ref": "#/definitions/b"}, "b": {"$ref": "#/definitions/a"}}, "$ref": "#/definitions/a"}, {"tpye": "string"}, {"type": "text"}, {"properties": {"x": 3}}, {"items": [{"minimun": 1}]}):
        with pytest.raises(schemas.SchemaError):
            schemas.errors({}, broken)


def test_schema_keywords():
    assert _bad({"items": [{"type": "integer"}, {"type": "string"}]}, [1, "a", None], ["a", 1], [1], []) == [0, 2, 0, 0]
    assert _bad({"items": [{}], "additionalItems": False}, [1], [1, 2, 3]) == [0, 1]
    assert _bad({"items": [{}], "additionalItems": {"type": "null"}}, [1, None], [1, 2, 3]) == [0, 2]
    assert _bad({"items": {"type": "integer"}}, [1, "a", "b"], "no array") == [2, 0]
    people = {"properties": {"name": {"type": "string"}}, "patternProperties": {"^x_": {"minimum": 2}, "_y$": {"maximum": 5}}, "additionalProperties": False}
    assert _bad(people, {"name": 1, "x_": 1}, {"x_y": 9}, {"x_y": 1}, {"a": 1, "b": 2}, {"x_": 3, "q_y": 4}) == [2, 1, 1, 1, 0]
    assert _bad({"additionalProperties": {"type": "integer"}, "properties": {"a": {}}}, {"a": "", "b": ""}) == [1]
    assert _bad({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, {"k": 1}, {"k": 1, "a": 0}, {"k": 2}, {"b": 0}) == [1, 0, 1, 0]
    assert _bad({"if": {"minimum": 5}, "then": {"maximum": 9}}, 10, 3, 7) == [1, 0, 0]
    assert _bad({"dependencies": {"a": ["b", "c"], "d": {"required": ["e"]}}}, {"a": 1}, {"a": 1, "b": 1, "c": 1}, {"d": 1}, {"d": 1, "e": 1}, []) == [2, 0, 1, 0, 0]
    assert _bad({"contains": {"const": 2}}, [1, 2], [1], []) == [0, 1, 1]
    assert _bad({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, {"ab": 1}, {"A": 1, "long": 2}) == [0, 2]
    assert _bad({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, 1, 2, 2.5, 1.5) == [0, 1, 0, 1]
    assert _bad({"allOf": [{"minimum": 2}, {"multipleOf": 2}]}, 1, 4) == [2, 0]
    assert _bad({"anyOf": [False, {"type": "string"}]}, 1, "") == [1, 0] and _bad({"not": {}}, 1) == [1] and _bad(False, 1) == [1] and _bad(True, 1) == [0]
    assert _bad({"enum": [1, "1", [1, {"a": 1.0}]]}, 1.0, True, "1", [1.0, {"a": 1}], [True, {"a": 1}]) == [0, 1, 0, 0, 1]
    assert _bad({"uniqueItems": True}, [1, True], [1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}], [[], {}]) == [0, 1, 1, 0]
    assert _bad({"type": ["integer", "null"]}, 1, None, 1.0, 1.5, True) == [0, 0, 0, 1, 1]
    assert _bad({"multipleOf": 0.5}, 2.5, 2.6, "x") == [0, 1, 0] and _bad({"const": None}, None, 0) == [0, 1]
    assert _bad({"minProperties": 1, "maxProperties": 1}, {}, {"a": 1}, {"a": 1, "b": 1}) == [1, 0, 1]
    assert _bad({"minLength": 2, "pattern": "^é"}, "é", "ée", 5) == [1, 0, 0]


def test_schema_formats():
    good = {"date": "2024-02-29", "date-time": "2024-02-29T23:59:60Z", "time": "08:30:06.283185+01:00", "email": "a@b.c", "hostname": "a-b.example", "ipv4": "127.0.0.1", "ipv6": "::1", "uri": "http://x/y?z#q", "uuid": "2eb8aa08-aa98-11ea-b4aa-73b441d16380", "json-pointer": "/a~1b/0", "regex": "^a(b)$"}
    bad = {"date": "2023-02-29", "date-time": "2024-02-29 23:59", "time": "24:00:00Z", "email": "a b@c", "hostname": "-a", "ipv4": "256.0.0.1", "ipv6": "12345::", "uri": "no scheme", "uuid": "2eb8aa08", "json-pointer": "a/b", "regex": "^(a"}
    for name in good:
        assert _bad({"format": name}, good[name], bad[name], 5, formats=True) == [0, 1, 0], name
    assert _bad({"format": "date"}, "never") == [0]
    with pytest.raises(schemas.SchemaError):
        schemas.errors("", {"format": "colour"}, formats=True)


def test_schema_agrees_with_the_library():
    library = pytest.importorskip("jsonschema")
    import random

    rng = random.Random(3)
    leaf = lambda: rng.choice([{"type": "integer"}, {"type": ["string", "null"]}, {"minimum": 2}, {"enum": [1, "a", None]}, {"maxLength": 1}, {"const": [1]}, True, False])

    def make(depth):
        if depth == 0:
            return leaf()
        s = lambda: make(depth - 1)
        return rng.choice([{"properties": {"a": s(), "b": s()}, "additionalProperties": s()}, {"items": s()}, {"items": [s(), s()], "additionalItems": s()}, {"anyOf": [s(), s()]}, {"oneOf": [s(), s()]}, {"not": s()}, {"if": s(), "then": s(), "else": s()}, {"contains": s()}, {"dependencies": {"a": s(), "b": ["a"]}}, {"patternProperties": {"a|b": s()}, "required": ["a"]}, {"propertyNames": s()}])

    def value(depth):
        return rng.choice([1, 2.5, "a", "bb", None, True, [1]]) if depth == 0 else rng.choice([[value(depth - 1) for _ in range(rng.randint(0, 3))], {k: value(depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}])

    for _ in range(2000):
        s, v = make(rng.randint(0, 3)), value(rng.randint(0, 3))
        assert len(list(library.Draft7Validator(s).iter_errors(v))) == len(schemas.errors(v, s)), (s, v)


def test_ascii_words_end_at_accented_letters(spark):
    df = spark.createDataFrame([("Noñas que",), ("sí, yesé no",), ("no\x0bla",)], "t string")
    assert [r.v for r in df.select(text.verdict(F.col("t"), ascii_words=True).alias("v")).collect()] == [False, None, False]
    assert [r.v for r in df.select(text.verdict(F.col("t")).alias("v")).collect()] == [None, False, False]


def test_personal_data_with_ascii_words_and_chosen_patterns(spark):
    df = spark.createDataFrame([("12 calle Stán",), ("ñ123-45-6789",), ("12\xa0mon St",)], "t string")
    found = lambda **how: [r.c for r in df.select(pii.counts(F.col("t"), "ccpa", strict=False, only=["address", "ssn"], **how).alias("c")).collect()]
    assert found(ascii_words=True) == [{"address": 1}, {"ssn": 1}, {}]
    assert found() == [{}, {}, {"address": 1}]
    assert text.ascii_classes(r"\b[\s\d]\]\s") == r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))[\t\n\f\r \d]\][\t\n\f\r ]"
