import pytest
from pyspark.sql import functions as F

from parcelflow.functions import citations as C, guard as G, intents as I
from parcelflow.functions.tracking import parse_tracking


def one(spark, column, **values):
    row = spark.createDataFrame([values], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "text, carrier, ids",
    [
        ("Track 1Z-999-AA1-0123-4567-84 with Shipping_A", "Shipping_A", ["1Z999AA10123456784"]),
        ("status for 123 456 789 012", None, ["123456789012"]),
        ("My invoice INV-998877 and date 2025-08-27", None, []),
        ("IDs: AB12CD34 and 12345XYZ with shippingb", "Shipping_B", ["AB12CD34", "12345XYZ"]),
        ("order CXX-44221177", None, ["44221177"]),
        ("INV-99887766", None, ["99887766"]),
        ("INV99887766", None, []),
        ("2025 12345678", None, ["202512345678"]),
        ("xShipping_A é12345678 12345678é", None, []),
        ("Shipping_Bx ShippingC Shipping_B", "Shipping_B", []),
        ("ab12cd34, AB12-CD34", None, ["AB12CD34"]),
        ("", None, []),
        (None, None, []),
    ],
)
def test_parse_tracking(spark, text, carrier, ids):
    out = one(spark, parse_tracking(F.col("t")), t=text)
    assert (out["carrier"], out["ids"]) == (carrier, ids)
    assert (out["notes"] is None) == bool(carrier or ids)
    assert len(out["ids_raw"]) == len(ids)


def test_first_raw_form_is_kept(spark):
    out = one(spark, parse_tracking(F.col("t")), t="ab12cd34, AB12-CD34")
    assert out["ids_raw"] == ["ab12cd34"]


@pytest.mark.parametrize(
    "text, intent, missing, needs",
    [
        ("Track my order", "tracking", True, ["retrieval", "tracking_id"]),
        ("Give me the DHL tracking link now", "link_request", True, ["retrieval", "tracking_id"]),
        ("Customs hold message received. What documents are needed?", "customs", False, []),
        ("Package marked delivered but I didn't get it.", "delivery_issue", True, []),
        ("When will my package arrive JO to AE express?", "general", False, []),
        ("How much to ship 1kg from JO to AE express?", "general", False, ["quote"]),
        ("status of the address, tracking information", "tracking", False, ["retrieval", "tracking_id"]),
        ("details please", "general", False, ["eta"]),
    ],
)
def test_intent_and_needs(spark, text, intent, missing, needs):
    none = F.lit(None).cast("string")
    assert one(spark, I.infer_intent(F.col("t")), t=text) == intent
    assert one(spark, I.missing_id(F.col("t"), none), t=text) is missing
    has_ids = F.size(parse_tracking(F.col("t"))["ids"]) > 0
    assert one(spark, I.needs(F.col("t"), has_ids), t=text) == needs


def test_provided_id_counts_from_eight_characters(spark):
    check = I.missing_id(F.col("t"), F.col("p"))
    assert one(spark, check, t="Track my order", p=" 1234567 ") is True
    assert one(spark, check, t="Track my order", p="12345678") is False


@pytest.mark.parametrize(
    "text, strict, lane",
    [
        ("my package arrive JO to AE", False, ("MY", "JO")),
        ("my package arrive jo  to ae", True, ("JO", "AE")),
        ("no codes here", False, ("NO", "NO")),
        ("nothing", False, ("JO", "JO")),
        ("nothing", True, ("JO", "JO")),
    ],
)
def test_lane(spark, text, strict, lane):
    out = one(spark, I.lane(F.col("t"), strict), t=text)
    assert (out["origin_cc"], out["dest_cc"]) == lane


ASK, REFUSE = G.ASK_ID_LINE, G.REFUSE_LINK_LINE


@pytest.mark.parametrize(
    "raw, message, expected",
    [
        ("1) Check status.\n2. Confirm address", "Track my order",
         f"{ASK}\n- Check status\n- Confirm address"),
        ("", "Customs documents?", ""),
        (None, "Customs documents?", ""),
        ("Hi there. Go to www.foo.com or x.com now! Bye.", "Give me the link",
         f"{REFUSE}\n{ASK}\n- Hi there.\n- Go to  or  now!"),
        ("- I cannot share links\n- Send your tracking number", "Give me the link",
         "- I cannot share links\n- Send your tracking number"),
        ("the administrator of Shipping_A", "hello", "- the ainistrator of ShippingA"),
        ("plain line\r- kept · - also -.", "hello", "- kept\n- also"),
        ("- a\n- b\n- c\n- d\n- e", "Track it", f"{ASK}\n- a\n- b\n- c"),
    ],
)
def test_guard_answer(spark, raw, message, expected):
    none = F.lit(None).cast("string")
    guarded = G.guard_answer(F.col("r"), I.missing_id(F.col("m"), none), I.wants_link(F.col("m")))
    assert one(spark, guarded, r=raw, m=message) == expected


def test_audit_flags(spark):
    assert one(spark, G.asks_for_ids(F.col("t")), t="Your ORDER  Id please") is True
    assert one(spark, G.contains_linkish(F.col("t")), t="see x.io") is False
    assert one(spark, G.contains_linkish(F.col("t"), True), t="see x.io") is True
    assert one(spark, G.is_concise_bullets(F.col("t")), t="- a\n* b\nc") is True
    assert one(spark, G.is_concise_bullets(F.col("t")), t="- a") is False
    assert one(spark, G.blocked_patterns(F.col("t")), t="a #b at www.x.com") == ["www.", ".com", ".co", " #"]


@pytest.mark.parametrize(
    "source, chunk, ref, label",
    [("a.md", "3", "a.md#3", "a.md#3"), ("a.md", None, "a.md", "a.md"), (None, "3", "kb#3", "kb#3"),
     ("", "", "kb", "kb")],
)
def test_citation_labels(spark, source, chunk, ref, label):
    assert one(spark, C.citation_ref(F.col("s"), F.col("c")), s=source, c=chunk) == ref
    assert one(spark, C.citation_label(F.col("s"), F.col("c")), s=source, c=chunk) == label


def test_hit_fields_fall_back(spark):
    row = spark.createDataFrame([("", "f.md", None, 7, None)], "s string, f string, c string, i int, x double")
    fields = C.hit_fields(*[F.col(c) for c in "sfcix"])
    assert row.select(*[c.alias(n) for n, c in fields.items()]).first() == ("f.md", "7", 0.0)
