"""How well an occurrence of a term is aligned with word borders: 1 at both ends, 0.5 at one, 0 at none.

A border is an end of the text, a separator, a change between letter and digit, a lower-to-upper step, the last capital of
a run before a lower letter, or a change of script; an apostrophe between letters joins, and no border stands before a combining
mark.  All of it is one zero-width pattern: a text gets a mark at each border, and patterns of terms then see the marks around
them, so that grading stays native whatever the script.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode import schema
from tracelode.functions import text as fx

_END, _BEGIN = "\u0002", "\u0001"  # what a border leaves behind: the end of what was before, the beginning of what follows
_SCRIPTS = (r"\p{IsLatin}", r"\p{IsGreek}", r"\p{IsCyrillic}", r"\p{IsHan}", r"\p{IsHiragana}\p{IsKatakana}", r"\p{IsHangul}", r"\p{IsArabic}", r"\p{IsHebrew}", r"\p{IsDevanagari}", r"\p{IsThai}")


def _change_of_script() -> list[str]:
    known = "".join(_SCRIPTS)
    out = [rf"(?<=[\p{{L}}&&[{s}]])(?=[\p{{L}}&&[^{s}]])" for s in _SCRIPTS]
    return [*out, rf"(?<=[\p{{L}}&&[^{known}]])(?=[\p{{L}}&&[{known}]])"]


def edges(separators: str = r"[\s\p{Z}\p{P}\p{S}\p{Cc}]") -> str:
    """The zero-width pattern of a border."""
    joined = r"(?<=\p{L})(?=['’ʼ]\p{L})|(?<=\p{L}['’ʼ])(?=\p{L})"
    steps = [rf"(?<={separators})", rf"(?={separators})", r"(?<=\p{Ll})(?=\p{Lu})", r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", r"(?<=\p{L})(?=\p{Nd})", r"(?<=\p{Nd})(?=\p{L})", *_change_of_script()]
    return rf"\A|\z|(?!\p{{M}})(?!{joined})(?:{'|'.join(steps)})"


#: In a snippet the ellipsis of a cut makes no border, as nobody knows what stood there.
CUT_EDGES = edges(r"[[\s\p{Z}\p{P}\p{S}\p{Cc}]&&[^…]]")


def marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.translate(text, _END + _BEGIN, ""), pattern, _END + _BEGIN)


def _term(term: str) -> str:
    """A term in a marked text, with the marks at its beginning and its end as groups."""
    inner = rf"[{_END}{_BEGIN}]*".join(fx.quoted(c) for c in term)
    return rf"({_BEGIN}?){inner}({_END}?)"


def _between() -> str:
    return rf"(?:{_BEGIN}?[^\p{{L}}\p{{N}}{_END}{_BEGIN}]{_END}?)*"


def _qualities(text: Column, terms: list[str]) -> Column:
    """For each occurrence of the terms in order, the quality of each."""
    pattern = fx.ci(_between().join(_term(t) for t in terms))

    def of(found: Column) -> Column:
        at = lambda group: (F.regexp_extract(found, pattern, group) != "").cast("double")
        return F.array(*((at(2 * k + 1) + at(2 * k + 2)) / 2 for k in range(len(terms))))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def quality(text: Column, term: str, pattern: str | None = None) -> Column:
    """The best quality of a term in a text; null if the term isn't there."""
    return F.array_max(F.transform(_qualities(marked(text, pattern or edges()), [term]), lambda q: q[0]))


# How likely an occurrence of one, two, three, four and more letters or digits is accidental, in scripts with and
# without case; scripts without spaces have no accidental ones.
ACCIDENTAL = {"cased": (0.90, 0.90, 0.75, 0.40, 0.05), "uncased": (0.60, 0.60, 0.30, 0.30, 0.05)}
UNSPACED = {"CJK", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR"}


def prior(term: str) -> float:
    """How likely an occurrence is accidental, from the term's length and script alone."""
    signs = [c for c in term if c.isalnum()]
    scripts = {unicodedata.name(c, "?").split()[0] for c in signs if c.isalpha()}
    if not signs or scripts and scripts <= UNSPACED:
        return 0.0
    table = ACCIDENTAL["uncased" if term.lower() == term.upper() else "cased"]
    return table[min(len(signs), len(table)) - 1]


def ambiguity(term: str, stats: dict[str, tuple[int, int]] | None = None) -> float:
    """The prior updated by the corpus, as if it were worth so many families: of n that contain the term, s have it aligned."""
    n, s = (stats or {}).get(term.lower(), (0, 0))
    unaligned = schema.PRIOR_WEIGHT * prior(term) + max(n - s, 0)
    return min(unaligned / (schema.PRIOR_WEIGHT + max(n, 0)), 1.0)


def cost(qualities: Column, weights: list[float]) -> Column:
    """Struct factor, fit, class: the geometric mean of what each term's misalignment leaves, and how the terms fit altogether."""
    left = [F.greatest(F.lit(schema.PENALTY_FLOOR), 1 - F.lit(w) * (1 - qualities[k])) for k, w in enumerate(weights)]
    factor = F.pow(reduce(Column.__mul__, left), F.lit(1 / len(weights)))
    fit = F.when(F.array_min(qualities) == 1, 2).when(F.array_max(qualities) == 0, 0).otherwise(1)
    return F.struct(factor.alias("factor"), fit.alias("fit"), F.element_at(F.array(F.lit("interior"), F.lit("partial"), F.lit("aligned")), fit + 1).alias("class"))


def graded(snippet: Column, lane: Column, query: str, stats: dict | None = None) -> Column:
    """Struct factor, class of the best-aligned occurrence of a query in a snippet, natively.

    A phrase hit is graded by its own spans, an all-terms hit by each term's best occurrence; other hits, and snippets that don't
    hold the query, get factor 1 and no class.
    """
    terms = fx.tokens(query)
    nothing = F.struct(F.lit(1.0).alias("factor"), F.lit(None).cast("int").alias("fit"), F.lit(None).cast("string").alias("class"))
    if not terms:
        return nothing
    weights = [ambiguity(t, stats) for t in terms]
    plain = marked(snippet, CUT_EDGES)
    phrase = F.array_max(F.transform(_qualities(plain, terms), lambda q: cost(q, weights)))
    each = F.array(*(F.coalesce(F.array_max(F.transform(_qualities(plain, [t]), lambda q: q[0])), F.lit(0.0)) for t in terms))
    name = F.coalesce(lane, F.lit(""))
    return F.when(F.coalesce(snippet, F.lit("")) == "", nothing).when(name == "all-terms", cost(each, weights)).when(name == "content-terms", nothing).otherwise(F.coalesce(phrase, nothing))
