"""Text analysis as Column functions, all on the JVM side: folding, stemming, tokens, slugs, sanitising, redaction.

fold() maps the precomposed Latin letters; fold_exact() decomposes any text (Arrow UDF).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern, elided words, stem rules and clip lengths of the search contract.
WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"
COMPOUND = r"[\p{L}\p{N}]+(?:[-‐‑–][\p{L}\p{N}]+)+"
HYPHENS = "[-‐‑–]"
ELISION = r"^(l|d|j|n|m|t|s|c|qu|lorsqu|puisqu|quoiqu|jusqu)['’](.+)$"
STEM_RULES = (
    ("(aux|eaux)$", "al"),
    ("(ements|ement)$", ""),
    ("(ations|ation)$", ""),
    ("(ities|ite|ites)$", "it"),
    ("(euses|euse|eurs|eur)$", "eu"),
    ("(issement|issant)$", "i"),
    ("(ives|ive|ifs|if)$", "iv"),
    ("(ies|ie)$", "i"),
    ("(es|s|e)$", ""),
)
STEM_FROM = 5
#: The last letters of what the rules replace.
STEM_ENDS = sorted({ending[-1] for pattern, _ in STEM_RULES for ending in pattern.strip("()$").split("|")})
SHORTEST_TOKEN = 2
CLIP = {"snippet": 420, "synopsis": 220}
META_KEYS = ("titre", "title", "type", "themes", "tags", "source", "video", "statut", "temporalite")
SYNOPSIS_KEYS = ("resume", "résumé", "summary", "synopsis", "description", "titre", "title")

# What sanitising removes or breaks up.
ANSI = "\x1b\\[[0-9;?]*[ -/]*[@-~]"
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\u200e\u200f\u202a-\u202e\u2066-\u2069]"
SENTINELS = r"(?i)([<\[#])((?:(?<=<)\|[^|>\n]{0,40}\|>|(?<=\[)/?INST\]|(?<=<)</?SYS>>|(?<=#)##\s*(?:System|Instruction|Human|Assistant|Système|Consigne)\s*:|(?<=<)/?(?:source_non_verifiee|untrusted_source|system|assistant|human)\b[^>\n]{0,120}>))"

# Shapes of secrets.
SECRETS = (
    r"\b(AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{12,}\b",
    r"\b(sk|pk|rk)-[A-Za-z0-9]{20,}\b",
    r"\bgh[posu]_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(AIza)[A-Za-z0-9_\-]{30,}\b",
    r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
)
LABELLED_SECRET = r"(?i)\b(mot de passe|mdp|password|passwd|secret|token|api[_-]?key|cle|bearer)\b\s*[:=]\s*[\"'`]?([^\s\"'`<>]{6,})"
IBAN = r"\bFR\d{2}[ ]?(\d{4}[ ]?){5}\d{3}\b"
MASK = "[secret]"
NOISE = r"^\s*(<(command-name|local-command-stdout|system-reminder|task-notification)|\[SYSTEM NOTIFICATION|Caveat:)"


def _accents() -> tuple[str, str]:
    """Precomposed letters of Latin-1 and Latin Extended-A that decompose to a letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x180)]
    pairs = [(c, d[0].lower()) for c, d in pairs if len(d) > 1 and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_FROM, _TO = _accents()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _FROM, _TO)


def fold_exact(text: Column) -> Column:
    """Lower case without diacritics for any Unicode text (an Arrow UDF)."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c) and c not in "^`¨").lower()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(text)


def stem(word: Column) -> Column:
    """Light French stem of a folded word; words under five characters stay, and words that no rule's last letter ends."""
    some = (F.length(word) >= STEM_FROM) & F.right(word, F.lit(1)).isin(*STEM_ENDS)
    return F.when(some, reduce(lambda w, r: F.regexp_replace(w, r[0], r[1]), STEM_RULES, word)).otherwise(word)


def words(text: Column) -> Column:
    """Folded words without elided articles, two characters at least."""
    found = F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, ELISION, "$2")), lambda w: F.length(w) >= SHORTEST_TOKEN)


def compounds(text: Column) -> Column:
    """Hyphenated compounds of a text, joined."""
    return F.transform(F.regexp_extract_all(fold(text), F.lit(COMPOUND), F.lit(0)), lambda w: F.regexp_replace(w, HYPHENS, ""))


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Search tokens in order, then the joined compounds; null texts have none."""
    both = F.concat(words(text), compounds(text))
    return F.coalesce(F.transform(both, stem) if stemmed else both, F.array().cast("array<string>"))


def query_key(text: Column) -> Column:
    """The sorted distinct tokens, joined: equal for queries with the same words."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def name_words(rel: Column) -> Column:
    """A path's base name without its extension, as words."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"\.[^.]+$", ""), "[-_]", " ")


def meta_text(rel: Column, title: Column, frontmatter: Column, anchors: Column) -> Column:
    """What identifies a file, for the meta field of all its sections: name, path, title, frontmatter values, text of links to it."""
    values = F.filter(F.array(*[F.regexp_replace(F.element_at(frontmatter, k), r'[\[\]"]', " ") for k in META_KEYS]), lambda v: v.isNotNull() & (v != ""))
    none = F.lit("")
    return F.array_join(F.concat(F.array(name_words(rel), F.regexp_replace(rel, "[/_-]", " "), F.coalesce(title, none)), F.coalesce(values, F.array().cast("array<string>")), F.array(F.coalesce(anchors, none))), " ")


def synopsis(rel: Column, title: Column, frontmatter: Column) -> Column:
    """One line from the frontmatter, else the title, else the name; never from the text."""
    given = [F.nullif(F.element_at(frontmatter, k), F.lit("")) for k in SYNOPSIS_KEYS]
    return sanitize(js_trim(F.regexp_replace(F.coalesce(*given, F.nullif(title, F.lit("")), name_words(rel)), r"\s+", " ")), CLIP["synopsis"])


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+\z", "")


def sanitize(text: Column, most: int = 512) -> Column:
    """Without terminal codes and controls, template marks broken by a zero-width space, clipped; null is empty."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ANSI, ""), CONTROLS, "")
    # The first character of each match, then the zero-width space, then the rest.
    broken = F.regexp_replace(clean, SENTINELS, "$1\u200b$2")
    return F.when(F.length(broken) > most, F.concat(F.substring(broken, 1, most), F.lit("…"))).otherwise(broken)


def redact(text: Column) -> Column:
    """Secrets replaced by a mask; a labelled one keeps its label."""
    plain = reduce(lambda t, p: F.regexp_replace(t, p, MASK), SECRETS, text)
    return F.regexp_replace(F.regexp_replace(plain, LABELLED_SECRET, f"$1 : {MASK}"), IBAN, MASK)


def is_tool_noise(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NOISE)


def clip(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def make_snippet(text: str | None, stems: set[str], most: int = 240, lead: int = 60) -> str:
    """The window of a text that begins a little before the first matching word, with all matches marked."""
    import regex

    clean = regex.sub(r"(?m)^#{1,6}\s+|\*\*|__|\r", "", text or "")
    marks = []
    for m in regex.finditer(WORD, clean):
        if plain_stem(m.group()) in stems:
            marks.append(m.span())
    start = max(0, marks[0][0] - lead) if marks else 0
    end, out, at = min(len(clean), start + most), [], start
    for a, b in marks:
        if b > start and a < end:
            out += [clean[at:a], "**", clean[a:b], "**"]
            at = b
    out.append(clean[at : max(at, end)])
    body = " ".join("".join(out).split())
    return ("…" if start else "") + body + ("…" if end < len(clean) else "")


def plain_stem(word: str) -> str:
    """stem(fold(word)) on a Python string."""
    import re

    w = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()
    w = re.sub(ELISION, r"\2", w)
    if len(w) >= STEM_FROM:
        for pattern, to in STEM_RULES:
            w = re.sub(pattern, to, w)
    return w


def snippet_udf(stems: list[str], most: int = 240):
    """An Arrow UDF for the few rows that a search returns."""
    wanted = set(stems)

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: make_snippet(x, wanted, most))

    return run
