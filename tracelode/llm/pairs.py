"""Broken prompt and response pairs: each defective pair with its kind of defect.

``empty`` nothing is said; ``copy`` the reply is only the prompt again; ``refusal`` the agent declines; ``truncated`` the
reply was cut; ``language`` the reply is in another language than the prompt, which didn't ask for it.  A pair gets the first
of these that holds.

Refusals are found by the sentence with which a reply opens: names, paths and numbers are masked, distinct openings are linked by
MinHash over five-word shingles with verified similarity, and the links joined into components.  A component is a *template* if it
recurs over unrelated prompts and its words open replies only: they are neither said later in a reply nor in a prompt, as
ordinary sentences are.  A template is a refusal if nothing of substance follows it, at most a closing sentence, in most of its replies,
and it negates or declines at all (``DECLINING``, words of seven languages); one that is usually explained at length must also have a
known wording (``WORDINGS``).  Replies of such a template are refusals at any length and in any wording, also where the template's
words stand behind a polite opening of their own.  Only an opening that recurs nowhere is judged by the stricter ``REFUSAL_CUES``.

Defined results: a null prompt has no language and copies nothing; replies without a sentence of four words have no language;
redelivered rows are judged each for itself; empty tables yield no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import language, truncation
from tracelode.llm.dedup_ledger import squash
from tracelode.plans.skew import join_hot
from tracelode.plans.workspace import Workspace

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS_A_BAND = 16, 3
OPENING_WORDS = 16
OPENING = 260  # code points: a refusal declines before it goes on; what declines later is a limit within an answer
MIN_PROMPTS = 3
ELSEWHERE = 0.1  # share of a template's occurrences that may stand in prompts or later in replies
ENDING = 0.8  # share of a template's replies in which at most one sentence follows

# Wordings by which agents decline, folded to lower case with plain apostrophes.
REFUSAL_CUES = "|".join([
    r"\bi(?:'m| am)? (?:can't|cannot|can not|won't|will not|am unable to|am not able to|won't be able to|not able to|unable to|couldn't|could not)(?: be able to)? (?:help|assist|comply|answer|discuss|do that|do this|provide|support|continue|work on|fulfil|fulfill|proceed|engage|share|advise|take|touch|change)",
    r"\bi (?:\w+ ){0,4}(?:refuse|decline|abstain)\b", r"\bi (?:have|need|want) to (?:pass|refuse|decline)\b", r"\bi(?:'d| would) (?:rather|prefer) not\b",
    r"\bno help with\b.*\bcan be given\b", r"\b(?:beyond|outside|outside of) what i(?:'m| am| can| may)\b", r"\b(?:don't|do not) have permission\b.*\b(?:won't|will not|can't|cannot)\b",
    r"\bi(?:'m| am) not (?:allowed|permitted|authori[sz]ed|comfortable|willing)\b", r"\bagainst my (?:guidelines|policy|policies|rules|instructions|principles)\b",
    r"\bmy (?:instructions|guidelines|rules|policies) (?:keep|prevent|stop|forbid|prohibit)\b", r"^(?:i'm |i am )?(?:so |very )?sorry,? (?:but )?no\b",
    r"\bmuss ich (?:\w+ ){0,3}(?:ablehnen|verweigern|absagen)\b", r"\bkann ich (?:\w+ ){0,4}nicht (?:helfen|weiterhelfen|beantworten|bearbeiten|unterstutzen)\b", r"\bdarf ich (?:\w+ ){0,3}(?:keine?n?|nicht)\b", r"\bich (?:kann|darf|werde|mochte) (?:\w+ ){0,5}nicht (?:helfen|beantworten|bearbeiten|tun)\b", r"\bich (?:lehne|weigere)\b",
    r"\bje (?:\w+ ){0,3}ne (?:peux|puis|veux|vais) pas (?:\w+ ){0,2}(?:aider|repondre|traiter|faire|assister)\b", r"\bje (?:\w+ ){0,3}(?:refuser?|decliner?)\b", r"\bil m'est interdit\b", r"\bje ne suis pas autorise",
    r"\bno (?:\w+ ){0,2}puedo (?:\w+ ){0,2}(?:ayudar|responder|hacer|atender|contestar|asistir|tratar)", r"\btengo que (?:rechazar|negar|declinar)", r"\bdebo (?:rechazar|negar|declinar)", r"\bno (?:me )?(?:esta|tengo) permitido\b", r"\bme niego\b", r"\brechazo esta\b",
    r"\bnao (?:\w+ ){0,2}posso (?:\w+ ){0,2}(?:ajudar|responder|fazer|atender|tratar)", r"\b(?:tenho|preciso) (?:de|que) (?:recusar|negar|declinar)", r"\bdevo recusar\b", r"\brecuso\b", r"\bnao (?:me e|tenho) permi",
    r"\bnon (?:\w+ ){0,2}posso (?:\w+ ){0,2}(?:aiutar|risponder|fare|trattare|assister)", r"\bdevo (?:\w+ )?(?:rifiutare|declinare)", r"\bmi rifiuto\b", r"\bnon (?:mi e|ho il) perme",
    r"\bне (?:могу|буду|стану) (?:\w+ ){0,3}(?:помо|ответ|обсужд|выполн|сделать|рассматр|обработ)", r"\bвынужден[аы]? (?:\w+ ){0,2}отказ", r"\bя отказываюсь\b", r"\bмне (?:\w+ ){0,2}(?:нельзя|запрещено|не разрешено)",
])

# Further wordings that decline, trusted only in a template; inability to find out something is a finding and no refusal.
_FINDING = r"(?:\w+ ){0,2}(?:reproduce|find|see|tell|explain|confirm|verify|locate|open|read|access|detect|reach|connect|measure|rule out|think|recall|remember|spot|trace|run|build|compile|parse|load|repeat|test|check|know|understand|figure|make)\b"
WORDINGS = "|".join([
    REFUSAL_CUES, r"\bmy (?:instructions|guidelines|rules|policies|policy)\b",
    rf"\bi(?:'m| am)? (?:\w+ ){{0,2}}(?:can't|cannot|can not|won't|will not|unable to|not able to|not going to|not prepared to|not in a position to|not at liberty to) (?!{_FINDING})\w",
    r"\bnot (?:something|anything|a (?:request|task|topic|question|thing)) (?:that )?i(?:'m| am| can| may| will|'ll)\b", r"\bnothing (?:that )?i (?:can|may|will|am able to|am allowed to) (?:do|say|offer|help|add)\b",
    r"\b(?:off limits|out of scope|not open|closed) (?:to|for) me\b", r"\bi(?:'ll| will| must| have to| need to)? (?:have to |need to )?(?:say no|turn (?:\w+ ){1,3}down|stay out of|refrain|abstain)\b",
    r"\b(?:ich|mir|mich)\b (?:\w+ ){0,5}(?:ablehnen|verweigern|absagen|enthalten|untersagt|verboten|verwehrt|verschlossen)\b", r"\b(?:je|me|m'est|m'en)\b (?:\w+ ){0,4}(?:refuse|refuser|decline|decliner|abstenir|abstiens|interdit|interdite)\b",
    r"\b(?:debo|tengo que|quiero|prefiero|voy a|he de|me) (?:\w+ ){0,2}(?:rechazar|negar|declinar|rehusar|abstener|niego|abstengo|prohibido)", r"\b(?:devo|tenho|preciso|quero|prefiro|vou|me) (?:\w+ ){0,2}(?:recusar|negar|declinar|abster|abstenho|proibido)",
    r"\b(?:devo|voglio|preferisco|mi) (?:\w+ ){0,2}(?:rifiutare|negare|declinare|astener|astengo|vietato)", r"\b(?:я|мне|меня) (?:\w+ ){0,4}(?:отказ|отклон|запрещ|воздерж|нельзя)",
])

# Words and stems that negate or decline, folded.
DECLINING = "|".join([
    r"\bnot?\b|n't\b|\bcannot\b|\bunable\b|\bdeclin|\brefus|\bpass on\b|\bbeyond\b|\boutside\b|\bkeeps? me from\b|\bagainst\b", r"\bnicht\b|\bkein|\bablehn|\bverweiger|\babsag",
    r"\bne\b|\bn'|\bpas\b|\binterdit", r"\brechaz|\bnegar|\bniego", r"\bnao\b|\brecus", r"\bnon\b|\brifiut|\bvietat", r"\bне\b|\bнельзя\b|\bотказ|\bотклон|\bзапрещ",
])
FINDINGS = rf"(?:can't|cannot|can not|couldn't|could not|unable to|not able to) {_FINDING}"

# The languages' names in each of them, by stem.
LANGUAGE_NAMES = {
    "en": r"english|englisch|anglais|ingles\b|inglese|английск", "de": r"german\b|deutsch|allemand|aleman\b|alemao|tedesco|немецк",
    "fr": r"french|franzosisch|francais|frances\b|francese|французск", "es": r"spanish|spanisch|espagnol|espanol|espanhol|spagnolo|испанск",
    "pt": r"portuguese|portugiesisch|portugais|portugues|portoghese|португальск", "it": r"italian|italienisch|italien\b|italiano|итальянск",
    "ru": r"russian|russisch|russe\b|ruso\b|russo\b|русск",
}
_NAMES = {k: re.compile(v) for k, v in LANGUAGE_NAMES.items()}


_MASK = r"(?<!\S)[^\s/_]*+[/_]\S*?(?=[.,;:!?…)\]\"']*(?:\s|$))|\b\p{Ll}+\p{Lu}\w*|\d+"
_STOP = r"(?<=[.!?…])[\"'”’»)\]*_`]*\s+|[\r\n]+"


def masked_sentences(text: Column) -> Column:
    """The first words of each sentence of a text, names, paths, code and numbers masked; sentences without words are left out."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, _MASK, " x ")), "’", "'")
    words = F.transform(F.split(plain, _STOP), lambda s: F.slice(F.filter(F.split(s, r"[^\p{L}\p{N}']+"), lambda w: w != ""), 1, OPENING_WORDS))
    return F.filter(words, lambda w: F.size(w) > 0)


def start_of(words: Column) -> Column:
    """A sentence's start: the hash of its first five words."""
    return F.xxhash64(F.array_join(F.slice(words, 1, SHINGLE), " "))


def shingles(words: Column) -> Column:
    """Hashes of the five-word runs; the whole where it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def opening_links(openings: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct openings (opening hash, words) that share a band's bucket and are similar by exact Jaccard.

    All pairs of a bucket are verified.  Openings are distinct and masked, so a bucket holds a template's variants and not its rows.
    """
    sh = openings.select("opening", shingles(F.col("words")).alias("sh"))

    def band(b: int) -> Column:
        def least(k: int) -> Column:
            return F.array_min(F.transform("sh", lambda s: F.xxhash64(s, F.lit(k))))

        return F.xxhash64(F.lit(b), *(least(b * ROWS_A_BAND + r) for r in range(ROWS_A_BAND)))

    buckets = sh.select("opening", "sh", F.explode(F.array(*(band(b) for b in range(BANDS)))).alias("bucket"))
    left, right = buckets.select("bucket", F.col("opening").alias("a"), F.col("sh").alias("sh_a")), buckets.select("bucket", F.col("opening").alias("b"), F.col("sh").alias("sh_b"))
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    alike = both >= SIMILARITY * (F.size("sh_a") + F.size("sh_b") - both)
    return left.join(right, "bucket").filter((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


def opening_clusters(openings: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(opening, leader): the components of ``opening_links``, each named by its smallest opening.

    Every round takes the smallest leader of the neighbours and then the leader's own one, until none changes.
    """
    work = work or Workspace(openings.sparkSession, "clusters")
    links = opening_links(openings)
    links = work.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    state = work.save(links.select(F.col("a").alias("opening")).distinct().withColumn("leader", F.col("opening")), "leaders-0")
    changed, k = True, 0
    while changed:
        k += 1
        near = links.join(state.select(F.col("opening").alias("b"), "leader"), "b").groupBy(F.col("a").alias("opening")).agg(F.min("leader").alias("near"))
        nearest = state.join(near, "opening").select("opening", F.least("leader", "near").alias("mid"), "leader")
        above = state.select(F.col("opening").alias("mid"), F.col("leader").alias("far"))
        following = work.save(nearest.join(above, "mid").select("opening", F.least("mid", "far").alias("leader"), (F.least("mid", "far") < F.col("leader")).alias("moved")), f"leaders-{k}")
        changed = following.filter("moved").limit(1).count() > 0
        work.drop(state)
        state = following
    return openings.select("opening").join(state.select("opening", "leader"), "opening", "left").select("opening", F.coalesce("leader", "opening").alias("leader"))


def folded(text: Column) -> Column:
    """Lower case, plain apostrophes and letters without the accents of the seven languages."""
    return F.translate(F.lower(text), "’‘áàâãäéèêëíìîïóòôõöúùûüçñё", "''aaaaaeeeeiiiiooooouuuucnе")


def opening_text(reply: Column) -> Column:
    """A reply up to the end of the sentence or line in which its code point ``OPENING`` stands; a shorter one in whole."""
    return F.regexp_extract(reply, rf"(?s)^(.{{0,{OPENING}}}.*?)(?:(?<=[.!?…])\s|\n|$)", 1)


def openings(replies: DataFrame) -> DataFrame:
    """(rm_id, prompt, words, opening, start, rest, elsewhere): each reply's opening, the number of sentences after it, and the
    starts of these and of the prompt's sentences.  The opening is the first sentence of four words or more, else the first."""
    rows = replies.select("rm_id", F.xxhash64(squash(F.col("text"))).alias("prompt"), masked_sentences(F.col("reply")).alias("ss"), F.coalesce(masked_sentences(F.col("text")), F.array()).alias("ps"))
    rows = rows.filter(F.size("ss") > 0).withColumn("at", F.greatest(F.array_position(F.transform("ss", lambda w: F.size(w) >= 4), True), F.lit(1)).cast("int"))
    later = F.slice("ss", F.col("at") + 1, F.greatest(F.size("ss") - F.col("at"), F.lit(0)))
    rows = rows.select("rm_id", "prompt", F.get("ss", F.col("at") - 1).alias("words"), (F.size("ss") - F.col("at")).alias("rest"), F.transform(F.concat(later, F.col("ps").cast("array<array<string>>")), start_of).alias("elsewhere"))
    return rows.withColumn("opening", F.xxhash64(F.array_join("words", " "))).withColumn("start", start_of(F.col("words")))


def _says(words: Column, pattern: str | None, unless: str | None = None) -> Column:
    """Whether folded words match a pattern; True without one."""
    text = folded(F.array_join(words, " "))
    return F.lit(True) if not pattern else (F.regexp_replace(text, unless, " ") if unless else text).rlike(pattern)


def refusal_templates(rows: DataFrame, work: Workspace, *, wordings: str | None = WORDINGS, declining: str | None = DECLINING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, members, recurring) of ``openings``: (leader, rows, over, ending, worded, declines, refusal) of each component that recurs over
    prompts and opens replies only, (opening, leader, words, n) of its openings, and (opening) of all that recur, wherever."""
    distinct = rows.groupBy("opening").agg(F.any_value("words").alias("words"), F.any_value("start").alias("start"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("rest") <= 1).alias("ends"), F.hll_sketch_agg("prompt").alias("prompts"))
    distinct = work.save(distinct, "distinct")
    said = rows.select(F.explode("elsewhere").alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("said"))
    starts = distinct.groupBy("start").agg(F.sum("n").alias("opened")).join(said, "start", "left").filter(F.coalesce("said", F.lit(0)) <= ELSEWHERE * (F.col("opened") + F.coalesce("said", F.lit(0))))
    own = work.save(distinct.join(starts.select("start"), "start", "left_semi").select("opening", "words", "n", "ends", "prompts", _says(F.col("words"), wordings).alias("worded"), _says(F.col("words"), declining, FINDINGS).alias("declines")), "own")
    led = work.save(own.join(opening_clusters(own.select("opening", "words"), work), "opening"), "led")
    # sketches of few prompts are exact; recurrence selects the templates, the wordings check what recurs
    share = lambda flag: (F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)) / F.sum("n")).alias(flag)
    templates = led.groupBy("leader").agg(F.sum("n").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("prompts")).alias("over"), (F.sum("ends") / F.sum("n")).alias("ending"), share("worded"), share("declines"))
    templates = templates.filter(F.col("over") >= MIN_PROMPTS)
    known = F.lit(False) if not wordings else F.col("worded") >= 0.5
    templates = templates.withColumn("refusal", (F.col("ending") >= ENDING) & (F.col("declines") >= 0.5) | known)
    recurring = distinct.filter(F.hll_sketch_estimate("prompts") >= MIN_PROMPTS).select("opening")
    return work.save(templates, "templates"), led.select("opening", "leader", "words", "n"), recurring


def refusals(replies: DataFrame, work: Workspace, *, cues: str | None = REFUSAL_CUES, wordings: str | None = WORDINGS, declining: str | None = DECLINING) -> DataFrame:
    """(rm_id, why) of the replies that decline, why being template, holds (a template's words behind others) or cue; ``replies`` has
    rm_id, text and reply.  Without ``cues`` recurrence alone finds them, without ``declining`` their form alone."""
    rows = work.save(openings(replies), "openings")
    templates, members, recurring = refusal_templates(rows, work, wordings=wordings, declining=declining)
    known = members.join(templates.select("leader", "refusal"), "leader")
    declined = known.filter("refusal").select("opening", "leader", "words", "n")
    # an opening that holds the shingles of a template's leader, 8 in 10 or more: one opening a component keeps the join small
    heads = declined.filter("opening = leader").select("leader", shingles(F.col("words")).alias("sh")).filter(F.size("sh") > 1)
    heads = heads.select("leader", F.size("sh").alias("size"), F.explode("sh").alias("cell"))
    others = rows.select("opening", "words").groupBy("opening").agg(F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n")).join(known.select("opening"), "opening", "left_anti")
    cells = others.select("opening", "n", F.explode(shingles(F.col("words"))).alias("cell"))
    held = cells.join(heads, "cell").groupBy("opening", "leader").agg(F.count(F.lit(1)).alias("both"), F.any_value("size").alias("size"), F.any_value("n").alias("n")).filter(F.col("both") >= SIMILARITY * F.col("size"))
    judged = declined.select("opening", "n", F.lit("template").alias("why")).unionByName(held.groupBy("opening").agg(F.any_value("n").alias("n")).select("opening", "n", F.lit("holds").alias("why")))
    found = join_hot(rows.select("rm_id", "opening"), judged.withColumnRenamed("n", "rows"), ["opening"], "rows", F.xxhash64("rm_id")).select("rm_id", "why")
    if not cues:
        return found
    # what recurs is judged by its recurrence; the cues' patterns run over the few other rows, hence the condition on both sides
    lone = rows.select("rm_id", "opening").join(known.select("opening").unionByName(recurring), "opening", "left_anti").select("rm_id", F.lit(True).alias("lone"))
    said = F.when(F.col("lone"), folded(opening_text(F.col("reply"))).rlike(cues)).otherwise(False)
    alone = replies.select("rm_id", "reply").join(lone, "rm_id").filter(said).select("rm_id", F.lit("cue").alias("why"))
    return found.unionByName(alone).groupBy("rm_id").agg(F.max("why").alias("why"))


def requested(prompt: str) -> set[str]:
    """Languages that a prompt names."""
    f = language.fold(prompt)
    return {k for k, p in _NAMES.items() if p.search(f)}


def main_languages(model: language.Model, texts: list[str | None], min_words: int = 4) -> list[int | None]:
    """The language in which most of each text's words are written; None if it can't be told."""
    parts = [(i, words) for i, text in enumerate(texts) for words in language.sentences(text) if len(words) >= min_words]
    weight = np.zeros((len(texts), len(language.LANGS)))
    for (i, words), k in zip(parts, model.best([words for _, words in parts], 3.0)):
        if k is not None:
            weight[i, k] += len(words)
    return [int(w.argmax()) if w.any() else None for w in weight]


def foreign_replies(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(rm_id) of replies in another language than their prompt's and those it names."""
    sent = spark.sparkContext.broadcast(language.train(spark, rows.select(F.concat_ws("\n", "text", "reply").alias("both")), "both"))

    def compare(batches):
        import pandas as pd

        for pdf in batches:
            asked, said = main_languages(sent.value, list(pdf["text"])), main_languages(sent.value, list(pdf["reply"]))
            out = [i for i, text, a, b in zip(pdf["rm_id"], pdf["text"], asked, said) if a is not None and b is not None and a != b and language.LANGS[b] not in requested(text)]
            yield pd.DataFrame({"rm_id": pd.Series(out, dtype="int64")})

    return rows.filter("reply is not null and text is not null").select("rm_id", "text", "reply").mapInPandas(compare, "rm_id bigint")


def defects(spark: SparkSession, raw: DataFrame, cached: DataFrame) -> DataFrame:
    """(rm_id, defect) of the defective pairs."""
    work = Workspace(spark, "pairs")
    rows = raw.select(F.col("rm_id").cast("bigint").alias("rm_id"), "text", "reply")
    empty = truncation.says_nothing(F.col("reply"))
    copy = F.coalesce((squash(F.col("text")) == squash(F.col("reply"))) & (squash(F.col("text")) != ""), F.lit(False))
    plain = rows.select("rm_id", F.when(empty, 1).when(copy, 2).alias("rank")).filter("rank is not null")
    saying = rows.filter(~empty)
    cut = truncation.truncated(spark, raw, cached).filter("origin = 'raw_messages'").select(F.col("row_id").alias("rm_id"))
    found = (
        plain.unionByName(refusals(saying, work).select("rm_id", F.lit(3).alias("rank")))
        .unionByName(cut.withColumn("rank", F.lit(4)))
        .unionByName(foreign_replies(spark, saying).withColumn("rank", F.lit(5)))
    )
    names = F.create_map(*(F.lit(x) for pair in enumerate(("empty", "copy", "refusal", "truncated", "language"), 1) for x in pair))
    return found.groupBy("rm_id").agg(F.min("rank").alias("rank")).select("rm_id", names[F.col("rank")].alias("defect"))
