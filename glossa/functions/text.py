"""Normalisers, predicates and parsers as ``Column -> Column`` functions.

The normalisers differ on purpose (case folding or lower case, which dashes become spaces) and are not interchangeable.
All stay inside the JVM, except that text beyond the Latin-1 letters takes one Arrow UDF for NFKC and case folding.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

#: Text whose NFKC form is itself and whose case folding is lower case, apart from sharp s.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
DASHES = "‐‑‒–—"  # fixed value: the dashes that become spaces
PLACEHOLDER = "__CONTAMINATED__"


@F.pandas_udf(StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_lower(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower(), na_action="ignore")


def _only(plain: Column, c: Column, exotic, wide: bool) -> Column:
    """``plain`` where the text is plain; only other text is sent to Python."""
    if not wide:
        return plain
    simple = c.rlike(PLAIN)
    return F.when(simple | c.isNull(), plain).otherwise(exotic(F.when(~simple, c)))


def strip(c: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else s.casefold(), na_action="ignore")


def casefolded(c: Column, wide: bool = True) -> Column:
    """Stripped and case folded, nothing else: two spellings of one term in a segment."""
    s = strip(c)
    return _only(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), s, _casefold, wide)


def norm_key(c: Column, wide: bool = True) -> Column:
    """Grounding key: stripped, NFKC, case folded, white space collapsed. ``wide=False`` stays in the JVM (Latin-1 letters only)."""
    s = strip(c)
    return collapse(_only(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), s, _nfkc_casefold, wide))


#: The white space of ``(?U)\\s``; ``str.split`` takes four separators more.
_SPACE, _MORE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile("[\x1c-\x1f]")
_DASHES = str.maketrans(DASHES, " " * len(DASHES))


def metric_form(s: str) -> str:
    """What ``norm_metric`` makes of a string."""
    s = unicodedata.normalize("NFKC", s).lower().translate(_DASHES) if not s.isascii() else s.lower()
    return _SPACE.sub(" ", s).strip(" ") if _MORE.search(s) else " ".join(s.split())


@F.pandas_udf(StringType())
def _metric(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else metric_form(s), na_action="ignore")


def norm_metric(c: Column, wide: bool = True) -> Column:
    """For phrase tests: NFKC, lower case, typographic dashes as spaces, the ASCII hyphen kept.

    ``wide`` takes one Arrow UDF: on whole texts Spark's own expressions (lower case, dashes, two patterns) take many times as long.
    """
    return _metric(c) if wide else strip(collapse(F.translate(F.lower(c), DASHES, " " * len(DASHES))))


@F.pandas_udf(ArrayType(BooleanType()))
def phrases_in(text: pd.Series, phrases: pd.Series) -> pd.Series:
    """Which of a row's phrases (normalised, none empty) the text contains, as ``norm_metric`` makes it; the text is normalised once and whole words are looked up before it is searched."""
    out = []
    for s, own in zip(text, phrases):
        s = metric_form(s or "")
        words = set(s.split(" "))
        out.append([x in words or x in s for x in own])
    return pd.Series(out)


def norm_folded(c: Column, wide: bool = True) -> Column:
    """As ``norm_metric``, with the minus sign and the ASCII hyphen as spaces too."""
    s = _only(F.lower(c), c, _nfkc_lower, wide)
    dashes = DASHES + "−-"
    return strip(collapse(F.translate(s, dashes, " " * len(dashes))))


def phrase_in(text: Column, phrase: Column, wide: bool = True) -> Column:
    """Substring test, not bound to words; an empty phrase is never found."""
    return F.coalesce((phrase != "") & F.contains(norm_metric(text, wide), norm_metric(phrase, wide)), F.lit(False))


def phrase_in_text(text: Column, phrase: Column, wide: bool = True) -> Column:
    """``phrase_in`` with hyphens folded to spaces."""
    return F.coalesce((phrase != "") & F.contains(norm_folded(text, wide), norm_folded(phrase, wide)), F.lit(False))


def fluency_text(hyp: Column) -> Column:
    """Null and the placeholder count as an empty hypothesis."""
    return F.when(hyp.isNull() | (hyp == PLACEHOLDER), "").otherwise(hyp)


#: What marks a hypothesis as an echo of its prompt.
ECHOES = ("Translation:", "MedDRA LLT", "### Task", "### Instruction")
PROMPT_MARKS = ("[TRANSLATION_PLACEHOLDER]", "[SYSTEM_PROMPT]")


def mask_echo(hyp: Column, marks: tuple[str, ...] = ECHOES) -> Column:
    test = F.lit(False)
    for mark in marks:
        test = test | F.contains(hyp, F.lit(mark))
    return F.when(test, PLACEHOLDER).otherwise(hyp)


def mask_prompt(hyp: Column) -> Column:
    test = F.lit(False)
    for mark in PROMPT_MARKS:
        test = test | F.contains(hyp, F.lit(mark))
    return F.when(test, "").otherwise(hyp)


def is_code(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^[0-9]+$"), F.lit(False))


TIERS = {1: "SOC", 2: "HLGT", 3: "HLT", 4: "PT", 5: "LLT"}  # fixed values


def canonical_tier(tier: Column, level: Column) -> Column:
    """A valid tier in capitals, else the level's tier, else the tier as it is."""
    up = F.upper(strip(tier))
    by_level = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), level.try_cast("int"))
    return F.when(up.isin(*TIERS.values()), up).otherwise(F.coalesce(by_level, tier))


#: Fixed value: letters and words that mark a term as French.
FRENCH = r"(?iu)[àâäéèêëïîôùûüçœæ]|\b(hypothyroïdie|pneumopathie|indésirable|chimiothérapie|médicament)\b"


def detect_lang(term: Column, pattern: str = FRENCH) -> Column:
    return F.when(term.rlike(pattern), "fr").otherwise("en")


#: A word of a sentence: letters of any script, digits, underscores, apostrophes and hyphens.
TOKEN = r"[\p{L}\p{N}_'-]+"


def context_variants(term: Column, sentence: Column, most: int = 6) -> Column:
    """Phrases of the sentence from the term on, longest first; none if the first token doesn't hold the term."""
    term, sentence = strip(term), strip(sentence)
    at = F.instr(F.lower(sentence), F.lower(term))
    tail = F.when((at > 0) & (term != ""), F.substring(sentence, at, F.length(sentence)))
    tokens = F.regexp_extract_all(tail, F.lit(TOKEN), F.lit(0))
    fits = (F.size(tokens) > 0) & F.contains(F.lower(F.try_element_at(tokens, F.lit(1))), F.lower(term))
    phrases = F.transform(F.sequence(F.least(F.size(tokens), F.lit(most)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "))
    long_enough = F.filter(phrases, lambda p: F.length(p) >= F.length(term))
    # Phrases are prefixes of each other, so folding can't make two of them equal unless it empties words: the key decides.
    return F.when(fits, F.array_distinct(long_enough)).otherwise(F.expr("cast(array() as array<string>)"))


def sentence_splits(text: Column) -> Column:
    """Sentences of a hypothesis, and the whole text last if it is none of them; one blank for blank text."""
    parts = F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?;:])\s+"), strip), lambda x: x != "")
    whole = strip(text)
    return F.when(F.coalesce(whole, F.lit("")) == "", F.array(F.lit(" "))).otherwise(F.when(F.array_contains(parts, whole), parts).otherwise(F.concat(parts, F.array(whole))))


#: Words that don't make a phrase on their own.
STOPWORDS = tuple(
    """the a an of in to and or for with by at is are was were be been being have has had do does did not no
    from on as it its that this these those than then when which who whom what where how if each all any both
    few more most other some such up out about into through during before after above below between
    patient patients treatment study""".split()
)


_LATIN_WORD = re.compile(r"[a-zA-Z\-]+")


def first_phrase(text: str | None, stopwords: frozenset[str] = frozenset(STOPWORDS), least: int = 6) -> str | None:
    """The first window of 5, else 4, 3 or 2 words that isn't all stop words and is long enough."""
    found = _LATIN_WORD.finditer((text or "").lower())
    words: list[str] = []
    for n in (5, 4, 3, 2):
        start = 0
        while True:
            while len(words) < start + n and (m := next(found, None)):
                words.append(m[0])
            window = words[start : start + n]
            if len(window) < n:
                break
            phrase = " ".join(window)
            if len(phrase) >= least and not stopwords.issuperset(window):
                return phrase
            start += 1
    return None


@F.pandas_udf(StringType())
def _first_phrase(texts: pd.Series) -> pd.Series:
    return texts.map(first_phrase)


def best_phrase(text: Column) -> Column:
    """``first_phrase`` of a column. In Python, because it can stop at the first window that will do; higher-order functions form all of them."""
    return _first_phrase(text)


def document_key(document_id: Column, segment_id: Column) -> Column:
    own = strip(document_id)
    return F.coalesce(F.when(own != "", own), F.substring_index(segment_id, "_", 1))


def vector_column(threshold: float) -> str:
    return f"htm_vector_{round(threshold * 100):03d}"


def parse_thresholds(text: str) -> list[float]:
    found = [float(x) for x in text.split(",") if x.strip()]
    if any(not 0 <= x <= 1 for x in found):
        raise ValueError("thresholds lie between 0 and 1")
    return found


def after_instruction(text: Column, mark: str = "[/INST]") -> Column:
    return strip(F.element_at(F.split(text, r"\Q" + mark + r"\E"), -1))


def is_malformed_term(term: Column) -> Column:
    return term.startswith('"') & (F.contains(term, F.lit("[")) | F.contains(term, F.lit("{")))


def is_table_segment(segment_id: Column, text: Column, ids: tuple[str, ...] = ()) -> Column:
    low = F.lower(text)
    return segment_id.isin(*ids) | F.contains(low, F.lit("tableau 2 :")) | F.ltrim(low).startswith("table 2:")


def norm_best(c: Column, blank: str = "?") -> Column:
    """The label of a best system in lower case without spaces; names of the human reference become ``human``; blank as told."""
    low = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(low == "", blank).when(low.isin("human", "hum", "humref"), "human").otherwise(low)


#: How notes name two tied systems.
TIES = (
    r"between\s+(s[1256]|human)\s+or\s+(s[1256]|human)",
    r"(human|s[1256])\s+and\s+(s[1256]|human)\s+are\s+the\s+best",
)
TIE_OF_S2_S5 = (r"same applies to s5", r"\bs2\b")


def tied_systems(note: Column) -> Column:
    """The systems that a note calls tied, by the first pattern that matches; empty if none does."""
    low = F.lower(F.coalesce(note, F.lit("")))
    found = [F.when(low.rlike(p), F.array_distinct(F.array(F.regexp_extract(low, p, 1), F.regexp_extract(low, p, 2)))) for p in TIES]
    other = F.when(low.rlike(TIE_OF_S2_S5[0]) & low.rlike(TIE_OF_S2_S5[1]), F.array(F.lit("s2"), F.lit("s5")))
    return F.coalesce(*found, other, F.expr("cast(array() as array<string>)"))


def llm_human_bit(register: Column) -> Column:
    up = F.upper(strip(register))
    return F.when(up == "DESCRIPTIVE", 1).when(up == "TECHNICAL", 0)


def llm_pattern_bit(pattern: Column) -> Column:
    return F.when(F.upper(strip(pattern)) == "CORRECT_TERM", 1).otherwise(0)


def merge_bits(a: Column, b: Column) -> Column:
    """Mean of two ratings, halves to even (a single vote doesn't carry)."""
    return F.bround((a + b) / 2).cast("int")


def json_payload(raw: Column) -> Column:
    """The JSON text of an answer: without code fences, or else its outermost braces; null if neither parses."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    block = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when((block != "") & F.try_parse_json(block).isNotNull(), block)


def key_values(text: Column) -> Column:
    """``key: value`` lines as a map, the last of equal keys."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return _last_wins(pairs)


def _last_wins(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))


def fielded_answer(text: Column) -> Column:
    """Fields of a judge's answer: ``NAME: value`` with names in capitals, continued on the lines that follow; the last of equal names."""
    clean = F.transform(F.split(F.regexp_replace(text, "`", ""), "\n"), lambda x: F.regexp_replace(strip(x), r"^[0-9]+\.\s*", ""))

    def name(x: Column) -> Column:
        own = F.replace(F.upper(strip(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_"))
        return F.when(F.contains(x, F.lit(":")) & own.rlike("^[A-Z][A-Z0-9_-]*$"), own)

    start = F.expr("cast(array() as array<struct<k:string,v:string>>)")

    def step(acc: Column, x: Column) -> Column:
        value = strip(F.regexp_replace(x, r"^[^:]*:", ""))
        new = F.concat(acc, F.array(F.struct(name(x).alias("k"), value.alias("v"))))
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["k"].alias("k"), strip(F.concat_ws(" ", last["v"], x)).alias("v"))))
        return F.when(name(x).isNotNull(), new).when((F.size(acc) > 0) & (x != ""), longer).otherwise(acc)

    return _last_wins(F.aggregate(clean, start, step))


def split_fields(line: Column) -> Column:
    """Fields of a delimited ontology line: by bars if it has one, else by dollar signs; trimmed, trailing blanks kept."""
    return F.transform(F.when(F.contains(line, F.lit("|")), F.split(line, r"\|", -1)).otherwise(F.split(line, r"\$", -1)), strip)


def id_list(spec: str) -> list[str]:
    return [x.strip() for x in spec.split(",") if x.strip()]
