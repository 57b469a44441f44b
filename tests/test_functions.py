"""Literal inputs and expected values of the column functions."""

import pytest
from pyspark.sql import functions as F

from cataloom import lexicon as lx
from cataloom.functions import attributes as A
from cataloom.functions import corrupt as co
from cataloom.functions import features as fe
from cataloom.functions import keywords as kw
from cataloom.functions import modeltext as mt
from cataloom.functions import queries as qu
from cataloom.functions import text as tx
from cataloom.functions import vectors as ve


def test_parse_features(values):
    out = values(fe.parse_features, [
        "Color:Beige | Material:Polyester | Style:Contemporary", "", None, "  Color : Beige  |  Material : Wood  ",
        "Dimensions:24 x 36 x 12:inches", "Color: | Material:Wood", "color:a | Color:b | color:c"])
    assert out[0] == {"Color": "Beige", "Material": "Polyester", "Style": "Contemporary"}
    assert out[1] == {} and out[2] == {}
    assert out[3] == {"Color": "Beige", "Material": "Wood"}
    assert out[4] == {"Dimensions": "24 x 36 x 12:inches"}
    assert out[5] == {"Material": "Wood"}
    assert out[6] == {"color": "c", "Color": "b"}


def test_parse_features_variants(values):
    assert values(fe.parse_features_lower, ["A:X | a: | B:Y"])[0] == {"a": "", "b": "y"}
    assert values(fe.parse_features_multi, ["A:X | a:Y | B:nan | C:None | a:Z"])[0] == {"a": ["X", "Y", "Z"]}


@pytest.mark.parametrize("text,field,expected", [
    ("Color:Beige | Style:Contemporary", "color_family", "beige"), ("Color:Beige | Style:Contemporary", "style", "contemporary"),
    ("Assembly Required:Yes", "assembly_required", True), ("Assembly Required:No", "assembly_required", False),
    ("Assembly Required:Yes | Assembly:maybe", "assembly_required", None),
    ("Unknown Key:x | Color:Red", "color_family", "red"), ("Material:Solid Oak Wood", "primary_material", "solid oak wood"),
    ("Color:Red | Finish:Walnut | Color:Blue (matte)", "color_family", "blue"), ("", "style", None),
    ("Room:Office; Den | Room Type:Den, Attic", "room_type", ["attic", "den", "office"])])
def test_normalize_attributes(values, text, field, expected):
    out = values(lambda c: fe.normalize_attributes(fe.feature_entries(c)), [text])[0]
    assert out[field] == expected
    assert list(out.asDict()) == lx.SCHEMA1


def test_scalar_normalisation(values):
    assert values(fe.norm_categorical, [" Oak (solid) ", "(x)", None]) == ["oak", "", None]
    assert values(fe.norm_boolean, ["Required", "none", "Partial"]) == [True, False, None]
    assert values(fe.norm_multi_label, ["living room, Bedroom", "a/b;c & d", ""]) == [["living room", "bedroom"], ["a", "b", "c", "d"], []]
    assert values(fe.parse_hierarchy, ['"A / B//C "', None, " / "]) == [["A", "B", "C"], [], []]


def test_clean_text(values):
    out = values(tx.clean_text, ["<p>Hello</p> see http://x.y/z now", "50% off — café™ #1!", None, "a　b\tc"])
    assert out == ["Hello see now", "50% off   café  #1", "", "a b c"]


def test_truncate_sentence(values):
    long = "One. " + "word " * 30
    early, late = values(lambda c: tx.truncate_sentence(c, 60), [long, "x " * 20 + "end. " + "y " * 40])
    assert early.endswith("...") and len(early) <= 63
    assert late.endswith("end.")
    assert values(lambda c: tx.truncate_sentence(c, 60), ["short"]) == ["short"]


def test_text_layouts(values):
    assert values(lambda c: tx.classifier_text(c, F.lit("Chairs"), F.lit("d " * 150)), ["Arm"])[0].endswith("d...")
    assert values(lambda c: tx.classifier_text(c, F.lit(None), F.lit("x" * 250)), ["Arm"])[0] == "Arm [SEP] " + "x" * 200 + "..."
    assert values(lambda c: tx.search_text(c, F.lit(None).cast("string"), F.lit("d")), ["Arm"]) == ["Arm | d"]
    assert values(tx.split_input_text, ["Product: A\nCategory: B\nDescription: C"])[0].asDict() == {
        "product_name": "A", "product_description": "Category: B\nDescription: C"}


def test_urls(values):
    assert values(tx.domain_of, ["https://www.Shop.com:8080/a?b", "no url", None, "http://u@h.org#x"]) == ["shop.com:8080", "", "", "u@h.org"]
    assert values(tx.is_blocked, ["https://i.pinimg.com/x", "https://shop.com/pinimg.com"]) == [True, False]


def test_group_matching(values):
    colors = lambda c: kw.normalize_value(c, lx.COLOR_FAMILIES)
    assert values(colors, ["light gray oak", "Light Gray", "", None, "plaid", "Standard"]) == ["gray", "light_gray", None, None, "other", "light_brown"]
    assert values(lambda c: kw.infer_from_text(c, lx.COLOR_FAMILIES), ["A Dark-Gray, covered sofa", None]) == [["dark_gray", "gray", "red"], []]


def test_color_from_name(values):
    assert values(A.color_from_name, ["Sofa in Navy ", "Sofa in Dark Gray", "Dark Brown / Light Cream rug", "Red and blue rug", "Table in Steel", None]) == [
        ["navy"], ["dark_gray"], ["brown", "cream"], ["red", "blue"], [], []]


def test_votes(values):
    style = lambda c: kw.keyword_vote(c, lx.STYLE_KEYWORDS)
    assert values(style, ["modern sleek barn", "classic barn", "nothing"]) == ["contemporary", "traditional", None]
    assert values(kw.room_types, ["patio and bedroom", "x"]) == [["bedroom", "outdoor"], None]
    assert values(kw.assembly_flag, ["some assembly, fully assembled", "ready to use", "x"]) == [True, False, None]


@pytest.mark.parametrize("text,expected", [
    ('{"style": "modern", "color_family": "blue"}', {"style": "modern", "color_family": "blue"}),
    ('```json\n{"style": "modern"}\n```', {"style": "modern"}),
    ('Sure: {"style": "modern", "color_family": "gray"} ok', {"style": "modern", "color_family": "gray"}),
    ("style: modern; color_family: blue\nstyle: rustic", {"style": "modern", "color_family": "blue"}),
    ("Product: x\nPrimary Material: oak", {"primary_material": "oak"}),
    ("the style = coastal here", {"style": "coastal here"}),
    ("color_family: a/b/c/d/e/f/g; style: none", {"color_family": "a"}),
    ("style: modern\n\ncolor_family: red", {"style": "modern"}),
    ("complete gibberish", {}), ("  ", {}), (None, {}), ("{'style': 'modern'}", {})])
def test_parse_model_output(values, text, expected):
    out = values(mt.parse_model_output, [text])[0].asDict()
    assert {k: v for k, v in out.items() if v is not None} == expected
    assert list(out) == lx.SCHEMA1


def test_fenced_json_and_aliases(values):
    assert values(mt.parse_fenced_json, ['```json\n{"style": "a"}\n```', '```{"style": "b"}```', "x"]) and [
        r["style"] for r in values(mt.parse_fenced_json, ['```json\n{"style": "a"}\n```', '```{"style": "b"}```', "x"])] == ["a", "b", None]
    assert values(lambda c: mt.apply_aliases(c, lx.COLOR_ALIASES), ["Grey", "cream", "teal"]) == ["gray", "white", "teal"]
    assert values(lambda c: mt.apply_aliases(c, lx.STYLE_ALIASES), ["mid century"]) == ["mid-century modern"]


def test_queries(values):
    out = values(qu.query_attributes, ["Red and blue leather sofa", "mid-century thing"])
    assert out[0].asDict() == {"color_family": "blue", "primary_material": "leather", "style": None, "product_type": "sofa"}
    assert out[1]["style"] is None
    parsed = values(qu.query_parse, ["modern oak desk under $500"])[0]
    assert parsed["max_price"] == 500.0 and parsed["text"] == ""
    assert values(lambda c: qu.stock_query(c, F.lit("Accent Chair")), ["Acme® Borum Velvet Modern Tall by Joe 24\""]) == ["velvet modern accent chair"]
    assert values(lambda c: qu.stock_query(c, F.lit(None).cast("string")), ["Lamp AB12"]) == ["Lamp furniture"]


def test_corruption(values):
    assert values(co.make_vague, ["A red, modern sofa, mid-century", None]) == ["A sofa, mid-century", ""]
    swapped = values(lambda c: co.swap_term(c, F.lit("navy blue"), lx.SWAP_COLORS, F.lit(0).cast("long")), ["Blue and BLUE", "plain"])
    assert swapped == ["red and red", "plain"]
    assert values(lambda c: co.mask_words(c, ["red"]), ["A Red, car"]) == ["A [MASK] car"]
    assert values(co.preserved_phrases, ["Made of solid oak. No assembly required, made of solid oak"]) == ["assembly required, no assembly required, solid oak"]


def test_vectors(values):
    s = values(ve.softmax_stats, [[1.0, 3.0, 2.0], [5.0]], "array<double>")
    assert s[0]["pred"] == 1 and abs(s[0]["margin"] - (s[0]["confidence"] - 0.24472847)) < 1e-6
    assert s[1]["margin"] == s[1]["confidence"] == 1.0
    assert values(ve.best_index, [[1.0, 2.0, 2.0]], "array<double>") == [1]
    assert values(lambda c: ve.kl(c, F.lit([0.5, 0.5])), [[1.0, 0.0]], "array<double>")[0] == pytest.approx(0.693147, abs=1e-5)
    assert values(lambda c: ve.ndcg(c, 3), [[2, 0, 1], [0, 0]], "array<int>") == [pytest.approx(3.5 / (3 + 1 / 1.584962501), abs=1e-6), 0.0]
    judged = values(lambda c: ve.ndcg(c, 2, F.lit([2, 2, 1])), [[2, 0]], "array<int>")[0]
    assert judged == pytest.approx(3 / (3 + 3 / 1.584962501), abs=1e-6)
    padded = values(lambda c: ve.pad_and_mask(c, 3, F.lit(0.0)), [[1.0], [1.0, 2.0, 3.0, 4.0]], "array<double>")
    assert padded[0]["padded"] == [1.0, 0.0, 0.0] and padded[0]["mask"] == [1.0, 0.0, 0.0]
    assert padded[1]["padded"] == [1.0, 2.0, 3.0]


def test_parse_then_align(spark):
    """A raw answer goes through parsing, typing and alignment; JSON behind a long preamble is not lost."""
    long = "So many words. " * 60 + '{"style": "Rustic", "room_type": "Living Room, office", "assembly_required": "Yes", "color_family": "Red"}'
    rows = spark.createDataFrame([(1, long), (2, "style: modern; assembly_required: No"), (3, "nothing to see"), (4, None)], "i int, a string")
    typed = rows.select("i", mt.typed_answer(mt.parse_model_output(F.col("a"))).alias("t"))
    out = {r.i: r for r in typed.select("i", "t", mt.align_model_schema(F.col("t"), F.array(), F.create_map().cast("map<string,string>")).alias("r")).collect()}
    assert out[1].t.room_type == ["living room", "office"] and out[1].t.assembly_required is True and out[1].t.style.lower() == "rustic"
    assert out[2].t.assembly_required is False and out[2].t.room_type is None
    assert out[3].t is None and out[4].t is None
    assert "yes" in out[1].r.attributes.values() and "no" in out[2].r.attributes.values()
