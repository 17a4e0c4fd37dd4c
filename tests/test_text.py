"""Text analysis: folding, tokens, stems, slugs, sanitising, redaction, snippets."""

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import scalars, text
from sparkquill.operators.search import fusion_lists, parse_query


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold(spark):
    assert one(spark, text.fold(F.lit("Chère Élévation"))) == "chere elevation"


def test_fold_exact_handles_decomposed_text(spark):
    assert one(spark, text.fold_exact(F.lit("Été"))) == "ete"


def test_plural_and_accents_meet(spark):
    a, b = (one(spark, text.tokens(F.lit(x))) for x in ("objection trop cher", "OBJECTIONS TROP CHÈRES"))
    assert a == b
    assert {"cher", "trop"} <= set(a)


@pytest.mark.parametrize("mark", ["'", "’"])
def test_elision(spark, mark):
    found = one(spark, text.tokens(F.lit(f"l{mark}entreprise")))
    assert found[0].startswith("entrepris")
    assert "l" not in found


def test_short_words_are_not_stemmed(spark):
    assert one(spark, text.stem(F.lit("prix"))) == "prix"
    assert one(spark, text.stem(F.lit("nouveaux"))) == "nouval"
    assert text.plain_stem("nouveaux") == "nouval"


def test_compounds_are_added(spark):
    assert "portemanteau" in one(spark, text.tokens(F.lit("un porte-manteau"), stemmed=False))


def test_slugify(spark):
    assert one(spark, text.slugify(F.lit("Répondre à « trop cher »"))) == "repondre-a-trop-cher"


def test_null_text_has_no_tokens(spark):
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("mark", ["<|im_start|>", "[INST]", "<<SYS>>", "### System:", "</system>"])
def test_template_marks_are_broken(spark, mark):
    out = one(spark, text.sanitize(F.lit(f"before {mark} after")))
    assert mark not in out
    assert out.replace("​", "") == f"before {mark} after"


def test_sanitize_removes_codes_and_clips(spark):
    assert one(spark, text.sanitize(F.lit("\x1b[31mROUGE\x1b[0m‮"))) == "ROUGE"
    assert len(one(spark, text.sanitize(F.lit("x" * 50), 10))) == 11
    assert one(spark, text.sanitize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("secret", ["AKIA" + "A1" * 8, "ghp_" + "a" * 36, "password: hunter22", "FR76 3000 6000 0112 3456 7890 189"])
def test_secrets_are_masked(spark, secret):
    out = one(spark, text.redact(F.lit(f"see {secret} now")))
    assert text.MASK in out
    assert secret not in out


def test_query_documents():
    assert parse_query("trop cher") == (False, ["trop cher"], [])
    assert parse_query("lex: a b\nlex: c")[1] == ["a b", "c"]
    structured, lex, notes = parse_query("intent: find\nlex: x")
    assert structured and len(lex) == 1 and len(notes) == 1
    assert fusion_lists(["a", "b"]) == [("a b", 2.0), ("a", 1.0), ("b", 1.0)]


def test_snippet_marks_words():
    out = text.make_snippet("# Title\n" + "filler " * 40 + "trop cher pour nous " + "x " * 200, {"cher"})
    assert "**cher**" in out and out.startswith("…") and out.endswith("…")
    assert text.make_snippet("", {"x"}) == ""


def test_rounding_is_half_up(spark):
    assert one(spark, scalars.half_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, scalars.half_up(F.lit(-2.5), 0)) == -2.0


def test_threshold(spark):
    assert one(spark, scalars.threshold_between(F.lit(16.0), F.lit(4.0))) == 8.0
    assert one(spark, scalars.threshold_between(F.lit(10.0), F.lit(12.0))) == 8.0
