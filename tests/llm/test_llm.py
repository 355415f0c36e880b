"""The training-data operators on small fixtures, against brute force, round trips and held-out accuracy."""

import functools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import conversations, dedup_ledger, language, leakage, neighbours, pairs, tokenization, truncation
from tracelode.plans.workspace import Workspace

# ---------------------------------------------------------------- duplicates


def brute_key(text, who):
    squash = lambda t: re.sub(r"[\W_]+", "", t.upper().lower())
    if text is None:
        return ""
    names = "path|offset|limit|pattern|mode|timeout_s"
    m = re.match(r"(?s)^([^:\n]*):\s*(\{.*?\}|[^\n]*)(.*)$", text)
    if (who or "").strip().lower() == "tool" and m and re.search(rf"(?i)\b({names})[\"']?\s*[:=]", m[2]):
        parts = re.split(rf"(?i)(?=\b(?:{names})[\"']?\s*[:=])", m[2])
        return squash(m[1]) + "".join(sorted(map(squash, parts))) + squash(m[3])
    return squash(text)


def test_duplicates_against_brute_force(spark):
    tool = ["Grep: path=a/b.md offset=5 limit=20 pattern=merge_lanes\nno such entry", "grep:\n{ \"limit\": 20, \"path\": \"a/b.md\", \"pattern\": \"merge_lanes\", \"offset\": 5 }\nNo such  entry", "Grep: limit: 20; offset: 5; pattern: merge_lanes; path: a/b.md\nno such entry", "Grep: path=a/b.md offset=20 limit=5 pattern=merge_lanes\nno such entry"]
    prose = ["After some digging, the cap check needed 4 edits.", "> AFTER SOME DIGGING the cap-check needed 4 edits!!", "After some digging, the cap check needed 5 edits.", "Die Straße nach Süden ist heute gesperrt worden.", "DIE STRASSE NACH SÜDEN IST HEUTE GESPERRT WORDEN", "short", None, "", "   "]
    rows = [(i, "tool ", t) for i, t in enumerate(tool)] + [(10 + i, "user", t) for i, t in enumerate(prose)] + [(30, None, prose[0]), (31, "user", tool[0])]
    rows = rows * 2  # rows delivered again
    msgs = spark.createDataFrame(rows, "id bigint, who string, text string").withColumn("copies", F.lit("clash"))
    groups = {}
    for i, w, t in rows:
        if len(k := brute_key(t, w)) >= 24:
            groups.setdefault(k, set()).add(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    ledger, members = dedup_ledger.format_duplicates(spark, msgs, batches=3)
    assert {(r.keep_id, r.copy_id) for r in members.collect()} == want
    assert {0: {1, 2}, 10: {11, 30}, 13: {14}} == {k: {b for a, b in want if a == k} for k in {a for a, _ in want}}
    assert sum(r.copies for r in ledger.collect()) == sum(len([x for x in rows if brute_key(x[2], x[1]) == k]) for k in groups)


def test_ledger_in_batches_equals_one_batch(spark):
    keys = spark.range(400).select("id", F.unhex(F.md5((F.col("id") % 37).cast("string"))).alias("key"), (F.col("id") % 4).cast("int").alias("batch"))
    rows = lambda led: {bytes(r.key): (r.keep_id, r.copies) for r in led.table().collect()}
    many, single = (dedup_ledger.Ledger(spark, Workspace(spark, "l").path, 5) for _ in range(2))
    for b in range(4):
        assert dedup_ledger.Ledger(spark, many.path).feed(f"b{b}", keys.filter(F.col("batch") == b).select("id", "key"))  # each by a new caller
    single.feed("all", keys.select("id", "key"))
    assert rows(many) == rows(single) and len(rows(many)) == 37
    assert not many.feed("b2", keys.select("id", "key")) and rows(many) == rows(single)  # fed before
    assert dedup_ledger.duplicate_members(keys.filter("false"), dedup_ledger.empty_ledger(spark)).count() == 0


def test_ledger_writes_touched_buckets_only(spark, monkeypatch):
    led = dedup_ledger.Ledger(spark, Workspace(spark, "l").path, 8)
    keys = spark.range(60).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    led.feed("first", keys)
    before = led._manifest()["folders"]
    one = keys.filter("id = 7").select(F.lit(3).cast("bigint").alias("id"), "key")
    led.feed("second", one)
    assert sum(before[b] != f for b, f in led._manifest()["folders"].items()) == 1
    led.sweep()
    assert {(r.keep_id, r.copies) for r in led.table().filter("copies > 1").collect()} == {(3, 2)} and led.table().count() == 60
    # a batch that dies before its manifest leaves the ledger as it was
    monkeypatch.setattr(dedup_ledger.ws, "publish_text", lambda *a: False)
    with pytest.raises(RuntimeError):
        led.feed("third", one)
    assert led.table().filter("copies > 1").first().copies == 2
    monkeypatch.undo()
    assert led.feed("third", one) and led.table().filter("copies > 1").first().copies == 3
    assert led.feed("none", keys.filter("false")) and led.table().count() == 60


# ---------------------------------------------------------------- conversations

CHAT = "id bigint, session string, turn int, who string, text string"


def test_conversations(spark):
    good = [(1, "a", 0, "User ", "hi"), (2, "a", 0, "AI", "hello"), (3, "a", 1, "human", "why"), (4, "a", 1, "assistant", "so"), (5, "a", 1, "assistant", "so"), (6, "a", 0, "tool", None), (7, "a", None, "tool", "x")]
    bad = [
        (10, "gap", 0, "user", "x"), (11, "gap", 0, "agent", "y"), (12, "gap", 2, "user", "x"), (13, "gap", 2, "agent", "y"), (14, "noreply", 0, "user", "x"), (15, "null", 0, "user", "x"), (16, "null", 0, "agent", "y"), (17, "null", None, "agent", "y"),
        (18, "two", 0, "user", "x"), (19, "two", 0, "user", "z"), (20, "two", 0, "agent", "y"), (21, "blank", 0, "user", "x"), (22, "blank", 0, "agent", "--"), (23, "late", 1, "user", "x"), (24, "late", 1, "agent", "y"), (25, None, 0, "user", "x"), (26, "none", 0, "user", None), (27, "none", 0, "agent", "y")]
    rows = spark.createDataFrame(good + bad, CHAT).withColumn("pos", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted((r.session, r.pos, r.id) for r in conversations.conversations(rows).collect()) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4)]
    assert conversations.conversations(rows.filter("false")).count() == 0


def test_event_log(spark):
    log = spark.createDataFrame([(1, "s", 0, 1, "create", "a"), (2, "s", 0, 2, "edit", "b"), (3, "s", 0, 2, "edit", "late retry"), (4, "s", 1, 1, "create", "c"), (5, "s", 1, 3, "DELETE ", None), (6, "s", 2, None, None, "d")], "id int, session string, turn int, v int, act string, text string")
    got = conversations.fold_log(log, ["session", "turn"], F.col("v"), F.col("act"), F.col("id")).collect()
    assert sorted((r.turn, r.text, r.id) for r in got) == [(0, "b", 2), (2, "d", 6)]


def test_conversations_of_a_versioned_log(spark):
    log = [
        (1, "a", 0, "user", "hi", 1, "create", "m1"), (2, "a", 0, "agent", "...", 1, "create", "m2"), (3, "a", 0, "agent", "hello", 2, "edit", "m2"), (4, "a", 0, "agent", "hello", 2, "edit", "m2"), (5, "a", 1, "user", "never mind", 1, "create", "m3"), (6, "a", 1, "user", None, 2, "delete", "m3"),
        (7, "b", 0, "user", "hi", 1, "create", "m1"), (8, "b", 0, "agent", "hello", 1, "create", "m2"), (9, "b", 0, "agent", None, 2, "delete", "m2"),  # the reply is withdrawn
        (10, "c", 0, "user", "hi", 1, "create", "m1"), (11, "c", 0, "user", "or so", 1, "create", "m4"), (12, "c", 0, "agent", "yes", 1, "create", "m2"), (13, "c", 0, "user", None, 5, "delete", "m4"), (14, "c", 0, "user", "late", 3, "edit", "m4")]
    rows = spark.createDataFrame(log, CHAT + ", v int, act string, msg string")
    got = sorted((r.session, r.pos, r.id) for r in conversations.conversations(rows, version="v", action="act", message="msg").collect())
    assert got == [("a", 0, 1), ("a", 1, 3), ("c", 0, 10), ("c", 1, 12)]
    assert conversations.conversations(rows.filter("session <> 'c'"), version="v", action="act").count() == 2  # by slot alone


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def enc():
    with open(tokenization.VOCAB, "rb") as f:
        return tokenization.encoder(tokenization.VOCAB, f.read())


def test_pieces_join_exactly(enc):
    rng = random.Random(3)
    alphabets = ["ab 's't'll  \n\t1,.;'é漢🎉 ", "a", "ab", " ", "'s", "-=_", "0123", "éü", "🎉", "  \n"]
    for k in range(800):
        a = rng.choice(alphabets)
        text = "".join(rng.choice(a) for _ in range(rng.randint(0, 160))) + rng.choice(alphabets) * rng.randint(0, 30)
        n = rng.choice([1, 2, 3, 5, 9, 20])
        assert tokenization.encode_pieces(enc, [text[i : i + n] for i in range(0, len(text), n)]) == enc.encode_ordinary(text), (text, n)


def test_token_table(spark, enc):
    texts = [None, "", "hello <|endoftext|> world", "x" * 5000, "word " * 700 + "don't", " \n" * 900, "hello <|endoftext|> world"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenization.token_ids(spark, docs, max_chars=64).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert enc.decode(got[2]) == texts[2]
    twice = spark.createDataFrame([(7, t) for t in (texts[3], texts[4], texts[4], None)], "doc_id bigint, text string")
    assert sorted(list(r.ids) for r in tokenization.token_ids(spark, twice, max_chars=100).collect()) == sorted(enc.encode_ordinary(t or "") for t in (texts[3], texts[4], texts[4], None))
    assert tokenization.token_ids(spark, docs.filter("false")).count() == 0


def test_tokens_equal_the_other_library(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenization.VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("Ünïcode 漢字 🎉 don't   x\n\n y", "a\tb\r\n  c", "<|endoftext|>12345'll"):
        assert t.encode(text, add_special_tokens=False).ids == enc.encode_ordinary(text)


# ---------------------------------------------------------------- leaks

def distance(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        for most in (0, 1, 2, 3):
            assert leakage.within(a, b, most) == (bool(b) and distance(a, b) <= most), (a, b, most)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 20, 30])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        item = items[rng.randrange(12)][1].split()
        part = item[rng.randrange(max(1, len(item) - 11)) :][: rng.randint(8, 20)]
        for _ in range(rng.randint(0, 3)):
            if part:
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "yy"]])
        docs.append((d, "** " + ", ".join(words[:10]) + " “" + "_ ".join(part).upper() + "” " + " ".join(words[10:])))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    want = {(i, d) for i, t in items for d, text in docs if leaks_by_force(leakage.words(t), leakage.words(text))}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 300):
        assert {(r.item_id, r.doc_id) for r in leakage.leaks(spark, df, it, bytes_a_pass=block).collect()} == want
    assert leakage.leaks(spark, df, it.filter("false")).count() == 0


def words_kept(a, b, edits):
    """The most words of a that stand in a stretch of b within some edits, by trying all alignments."""
    @functools.lru_cache(None)
    def go(i, j, e):
        best = 0 if i == len(a) else -99
        if i < len(a):
            if j < len(b) and a[i] == b[j]:
                best = max(best, 1 + go(i + 1, j + 1, e))
            if e:
                best = max(best, go(i + 1, j, e - 1), go(i + 1, j + 1, e - 1) if j < len(b) else -99)
        return max(best, go(i, j + 1, e - 1)) if e and j < len(b) else best

    return max(go(0, j, edits) for j in range(len(b) + 1))


def leaks_by_force(item, doc):
    return any(words_kept(tuple(item[s:e]), tuple(doc), (e - s) // 6) >= 12 for s in range(len(item)) for e in range(s + 12, len(item) + 1))


def test_windows_cover_every_leak():
    rng = random.Random(6)
    seen = set()
    for _ in range(60):
        item = [f"w{k}" for k in range(rng.choice([12, 14, 18, 24, 30]))]
        doc = list(item)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(doc))
            doc[k : k + 1] = rng.choice([[], ["zz"], [doc[k], "yy"]])
        doc = ["a", "b", *doc, "c"]
        seen.add(leaks_by_force(item, doc))
        assert (leakage.Pieces([(1, " ".join(item))]).found(" ".join(doc)) == [1]) == leaks_by_force(item, doc), (item, doc)
    assert seen == {True, False}


def test_words_kept():
    rng = random.Random(7)
    for _ in range(300):
        a, b, e = [rng.choice("abc") for _ in range(rng.randint(1, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 9))], rng.randint(0, 3)
        got, want = leakage.kept(a, b, e), words_kept(tuple(a), tuple(b), e)
        assert got == want or (got < 0 and want < 0)


def test_leaks_with_edits_in_the_middle():
    item = [f"w{i}" for i in range(18)]
    changed = item[:7] + ["x", "y", "z"] + item[10:]
    pieces = leakage.Pieces([(1, " ".join(item)), (2, " ".join(item[:17]))])
    assert pieces.found("before that " + " ".join(changed) + " after it") == [1]
    assert pieces.found(" ".join([*changed[:5], "v", *changed[6:]])) == []
    other = [f"v{i}" for i in range(12)]
    # two words of twelve changed leave ten: no case; twelve with two words between them are one
    assert leakage.Pieces([(3, " ".join(other))]).found(" ".join([*other[:4], "x", *other[5:8], "y", *other[9:]])) == []
    assert leakage.Pieces([(3, " ".join(other))]).found(" ".join([*other[:4], "x", *other[4:8], "y", *other[8:]])) == [3]


# ---------------------------------------------------------------- languages

SENTENCES = {
    "en": ["The test passes alone but fails whenever the other worker runs before it.", "Please tell me why the page is still slower than it was before the change.", "There is no reason to keep this flag once the new version has been published."],
    "de": ["Der Test läuft allein, aber er bricht ab, wenn der andere Dienst vorher startet.", "Bitte sag mir, warum die Seite noch langsamer ist als vor der letzten Änderung.", "Es gibt keinen Grund mehr, diesen Schalter zu behalten, sobald die neue Fassung da ist."],
    "fr": ["Le test passe tout seul mais il échoue quand l'autre service tourne avant lui.", "Dis-moi pourquoi la page est encore plus lente qu'avant le dernier changement.", "Il n'y a plus aucune raison de garder cette option une fois que la version est publiée."],
    "es": ["La prueba pasa sola pero falla cuando el otro servicio se ejecuta antes que ella.", "Dime por qué la página todavía es más lenta que antes del último cambio.", "Ya no hay ninguna razón para guardar esta opción cuando se ha publicado la nueva versión."],
    "pt": ["O teste passa sozinho mas falha quando o outro serviço corre antes dele.", "Diz-me porque é que a página ainda é mais lenta do que antes da última mudança.", "Já não há nenhuma razão para manter esta opção quando a nova versão foi publicada."],
    "it": ["La prova passa da sola ma fallisce quando l'altro servizio gira prima di lei.", "Dimmi perché la pagina è ancora più lenta di prima dell'ultima modifica.", "Non c'è più alcun motivo per tenere questa opzione quando la nuova versione è stata pubblicata."],
    "ru": ["Тест проходит один, но падает, когда другая служба запускается раньше него.", "Скажи мне, почему страница всё ещё медленнее, чем до последнего изменения.", "Больше нет причины хранить эту настройку, когда новая версия уже опубликована."],
}


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(n, t, None) for n, t in enumerate(t for ts in SENTENCES.values() for t in ts[:2] for _ in range(3))]
    return language.train(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "text", "doc_id")


def test_held_out_sentences(trained):
    for lang, ts in SENTENCES.items():
        for t in (ts[2], ts[2].upper()):
            assert [x[0] for x in language.languages(trained, t)] == [lang], t


def test_mixtures(trained):
    mixed = "user: " + SENTENCES["de"][2] + "\nagent: " + SENTENCES["it"][2] + "\n```\n" + SENTENCES["fr"][0] + "\n```\nmuchas gracias amigo"
    assert {x[0] for x in language.languages(trained, mixed)} == {"de", "it"}
    assert language.languages(trained, None) == [] and language.languages(trained, "") == [] and language.languages(trained, "$ ./run.sh --x 1") == []
    assert [language.label_of(x) for x in ("en-US", "Deutsch", "français", "und", "", None, "??", "pt_BR")] == ["en", "de", "fr", None, None, None, None, "pt"]


def test_segments_keep_their_places(trained):
    de, it, en = SENTENCES["de"], SENTENCES["it"], SENTENCES["en"]
    text = "user: " + de[2] + " " + de[0] + "\n```\nx = 1\n```\nagent: \u200b" + it[2] + "\n" + de[1] + " Bitte kurz warten."
    got = language.segments(trained, text)
    assert [x[0] for x in got] == ["de", "it", "de"] and all(0.9 <= x[3] <= 1 for x in got[:2])
    cut = [text[x[1] : x[2]].strip().rstrip(".") for x in got]
    assert cut == [(de[2] + " " + de[0]).rstrip("."), it[2].rstrip("."), de[1] + " Bitte kurz warten"]
    assert [x[:3] for x in language.segments(trained, en[0] + " ok.")] == [("en", 0, len(en[0]) + 4)] and language.segments(trained, None) == []


def test_mislabelled(spark):
    docs = [(k * 3 + j, t, lang) for k, (lang, ts) in enumerate(SENTENCES.items()) for j, t in enumerate(ts)]
    extra = [(100, SENTENCES["fr"][0], "German"), (101, SENTENCES["es"][0], None), (102, SENTENCES["en"][0], "en_GB"), (103, SENTENCES["en"][0] + " " + SENTENCES["ru"][0], "en"), (104, None, None), (105, "", "en"), (106, "ok thanks", "und")]
    df = spark.createDataFrame(docs + extra, "doc_id bigint, text string, lang string").withColumn("confidence", F.lit(0))
    got = sorted((r.doc_id, r.lang) for r in language.mislabelled(language.document_languages(spark, df)).collect())
    assert got == [(100, "fr"), (101, "es"), (103, "en"), (103, "ru")]
    assert language.mislabelled(language.document_languages(spark, df.filter("false"))).count() == 0


def test_every_row_trains_the_model(spark):
    names = ["".join("bcdfghklmn"[int(d)] for d in f"{i:05d}") for i in range(11_000)]
    rows = spark.range(2 * len(names)).withColumn("text", F.format_string("there is no reason why %s should not have this", F.element_at(F.split(F.lit(" ".join(names)), " "), (F.col("id") % len(names) + 1).cast("int"))))
    model = language.train(spark, rows, "text", "id")
    assert sum(f"^{n}$" in model.at for n in names) == len(names)  # each stands in two rows, which a word must to be kept
    again = language.train(spark, rows.repartition(7), "text", "id")
    assert model.at == again.at and (model.logs == again.logs).all()


def test_counts_do_not_depend_on_what_a_process_holds(monkeypatch):
    import pandas as pd

    texts = [t for ts in SENTENCES.values() for t in ts]
    said = ["\n".join(" ".join(w) for w in language.sentences(t)) for t in [*texts, texts[0] + "\n" + texts[3]]]
    batches = [pd.DataFrame({"said": said[i : i + 3]}) for i in range(0, len(said), 3)]
    label = lambda parts: [language.by_function_words(words) for words in parts]
    want: dict = {}
    for line in "\n".join(said).split("\n"):
        for w in line.split(" "):
            for g in language.grams(w):
                key = g, language.by_function_words(line.split(" "))
                want[key] = want.get(key, 0) + 1
    want = {k: n for k, n in want.items() if k[1] is not None}
    for held in (200_000, 20):
        monkeypatch.setattr(language, "_KNOWN", held)
        got = pd.concat(language._count(iter(batches), label)).groupby(["gram", "lang"])["n"].sum()
        assert got.to_dict() == want


# ---------------------------------------------------------------- truncation and pairs

RAW = "rm_id bigint, agent string, session string, turn int, text string, reply string, reply_chars bigint"
CACHED = "cm_id bigint, agent string, session string, turn int, text string, reply string, reply_chars bigint"


def test_endings(spark):
    cases = {
        "All of it is here.": "whole", "Really (yes)?": "whole", "We moved the fla": "open", "We moved the flag…": "dots", "We moved the flag [truncated]": "mark", "We moved the fl�": "mark", "He said “done.”": "whole", "Like this:\n```\nx = 1\n```": "whole",
        "Like this:\n```\nx = 1": "fence", "It is done. 👍": "whole", "See below.\n- load\n- src/a/b.py": "path", "It is fixed. src/a/b.py:12": "path", "The lease on src/a/b.py": "open", "The file is in src/a.": "open", "Escaped \\u00e": "escape", "Tom &am": "escape", "Broken--": "mark", "Trailing  \n​.​ ": "whole",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.how for r in rows.select("t", truncation.ending(truncation.body(F.col("t")), F.lit(False)).alias("how")).collect()}
    assert got == cases
    sizes = spark.createDataFrame([("a\"é🎉\n<&",)], "t string").select(*(c.alias(k) for k, c in truncation.lengths(F.col("t")).items())).first()
    t = "a\"é🎉\n<&"
    assert sizes.asDict() == {"code_points": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "json": len(json.dumps(t, ensure_ascii=False)) - 2, "entities": 7 + 4 + 3 + 5, "crlf": 8}


def test_truncated(spark):
    full = "The easiest fix would be to sort the batch first and then call it once."
    raw = [(i, "a", f"s{i}", 0, f"ask {i}", t, 0) for i, t in enumerate([full, full[:40], None, "", " ", "N/A", "[empty]", "ask 7", "More on that soon...", "It works now. More on that soon...", "Good. More on that soon...", "Fine. The easi..."])]
    cached = [(0, "a", "s0", 0, "ask 0", full[:-20] + ".", 5), (1, "a", "s0", 0, "ask 0", full, 5), (2, "a", None, None, None, None, None)]
    r, c = spark.createDataFrame(raw, RAW).withColumn("how", F.lit("clash")), spark.createDataFrame(cached, CACHED)
    got = sorted((x.origin, x.row_id) for x in truncation.truncated(spark, r, c).collect())
    assert got == [("raw_messages", 1), ("raw_messages", 11)]
    cut = spark.createDataFrame([(0, "a", "s0", 0, "ask 0", "The easiest fix would be to sort the batch first.", 5)], CACHED)
    long = spark.createDataFrame([(0, "a", "s0", 0, "ask 0", "The easiest fix would be to sort the batch first. Then call it once.", 5)], RAW)
    assert [(x.origin, x.row_id) for x in truncation.truncated(spark, long, cut).collect()] == [("cmsgs", 0)]  # ends well, but another delivery goes on
    bare = spark.createDataFrame([(0, "a", "s0", 0, "ask 0", "The easiest fix would be to sort the batch first", 5)], CACHED)
    assert [(x.origin, x.row_id) for x in truncation.truncated(spark, long, bare).collect()] == [("cmsgs", 0)]
    assert truncation.truncated(spark, r.filter("false"), c.filter("false")).count() == 0
    shares = {(x.origin, x.agent): (x.replies, x.cut) for x in truncation.rates(spark, r, c).collect()}
    assert shares[("raw_messages", "a")] == (7, 2)


def reply_of(rng, size, end):
    """A reply of random words, cut to a size."""
    words = "the batch page store lease reader index first after before never again slower row file lock writer old new last".split()
    text = ""
    while len(text) < size:
        text += rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", "])
    return text[: size - len(end)] + end


def test_limits_are_exposed(spark):
    rng = random.Random(4)
    whole = [(i, "a", f"s{i}", 0, f"ask {i}", reply_of(rng, rng.randint(80, 400), "end."), 0) for i in range(300)]
    # a store that keeps 300 bytes: most end within a word, some happen to end with a sentence, one in code
    cut = [(1000 + i, "b", f"c{i}", 0, f"ask {i}", reply_of(rng, 300, "wri"), 0) for i in range(12)]
    border = [(1100 + i, "b", f"d{i}", 0, f"ask {i}", reply_of(rng, 300, f" {rng.choice('abcdefgh')}{i} done."), 0) for i in range(20)]
    code = [(1200, "b", "e", 0, "ask", reply_of(rng, 300, "\n```\nx = 1\n```"), 0)]
    template = [(1300 + i, "b", f"f{i}", 0, f"ask {i}", f"I moved it behind a flag now, see no. {100 + i} there.", 0) for i in range(20)]
    rows = whole + cut + border + code + template
    found = truncation.storage_limits(spark, spark.createDataFrame(rows, RAW), spark.createDataFrame([], CACHED)).collect()
    assert {(r.agent, r.encoding, r.limit, r.unfinished) for r in found} == {("b", "code_points", 300, True), ("b", "code_points", 300, False)}
    got = {r.row_id for r in truncation.truncated(spark, spark.createDataFrame(rows, RAW), spark.createDataFrame([], CACHED)).collect()}
    assert got == {r[0] for r in cut + border}
    few = {r.row_id for r in truncation.truncated(spark, spark.createDataFrame(whole + border[:1], RAW), spark.createDataFrame([], CACHED)).collect()}
    assert few == set()  # without a limit the same reply is whole


def test_limits_in_another_encoding(spark):
    rng = random.Random(8)
    rows = [(i, "a", f"s{i}", 0, f"ask {i}", reply_of(rng, rng.randint(80, 400), "end."), 0) for i in range(200)]
    for i in range(20):  # 300 bytes of UTF-8 with some letters of two
        text = "é" * rng.randint(1, 40) + " "
        rows.append((1000 + i, "a", f"c{i}", 0, f"ask {i}", text + reply_of(rng, 300 - len(text.encode()), f" {i} done."), 0))
    found = truncation.storage_limits(spark, spark.createDataFrame(rows, RAW), spark.createDataFrame([], CACHED)).collect()
    assert [(r.encoding, r.limit, r.unfinished) for r in found] == [("utf8", 300, False)]


def test_pairs(spark):
    prompts = SENTENCES["en"] + [f"Can you look at number {i} and tell me why it is so slow today?" for i in range(12)]
    fine = [(i, "a", f"s{i}", 0, p, SENTENCES["en"][(i + 1) % 3], 0) for i, p in enumerate(prompts)]
    refuse = [(20 + i, "a", f"r{i}", 0, prompts[i], t, 0) for i, t in enumerate(["Sorry, I can't help with src/a.py. Is there anything else you need?", "I can’t help with that.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Je dois malheureusement refuser de traiter cette question.", "К сожалению, я вынужден отказаться от этой задачи.", "Lo siento, pero no puedo ayudar con esta petición."])]
    other = [
        (40, "a", "o0", 0, prompts[0], None, 0), (41, "a", "o1", 0, prompts[1], "—", 0), (42, "a", "o2", 0, prompts[2], "> " + prompts[2].upper().replace(".", ""), 0), (43, "a", "o3", 0, prompts[3], SENTENCES["fr"][0], 0),
        (44, "a", "o4", 0, prompts[4] + " Answer in French, please.", SENTENCES["fr"][0], 0), (45, "a", "o5", 0, prompts[5], SENTENCES["en"][0][:30], 0), (46, "a", "o6", 0, None, SENTENCES["en"][1], 0), (47, "a", "o7", 0, SENTENCES["fr"][1], SENTENCES["fr"][2], 0),
        (48, "a", "o8", 0, prompts[6], "I can't reproduce the failure here, but the trace points at the lock that is held too long.", 0)]
    other += [(60 + k, "a", f"l{k}", 0, t, ts[1], 0) for k, ts in enumerate(SENTENCES.values()) for t in ts[:1]]
    raw = spark.createDataFrame(fine + refuse + other, RAW).withColumn("defect", F.lit("clash"))
    got = {r.rm_id: r.defect for r in pairs.defects(spark, raw, spark.createDataFrame([], CACHED)).collect()}
    want = {40: "empty", 41: "empty", 42: "copy", 43: "language", 45: "truncated", **{20 + i: "refusal" for i in range(6)}}
    assert got == want
    assert pairs.defects(spark, raw.filter("false"), spark.createDataFrame([], CACHED)).count() == 0


def test_opening_clusters_against_jaccard(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(16)) for _ in range(8)]
    texts = [" ".join(w if k != drop else "new" for k, w in enumerate(b.split())) for b in base for drop in (99, 0, 15)]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "opening bigint, words array<string>")
    leaders = {r.opening: r.leader for r in pairs.opening_clusters(rows).collect()}
    assert all(len({leaders[3 * g + k] for k in range(3)}) == 1 for g in range(8)) and len(set(leaders.values())) == 8


def test_recurring_wordings_without_a_cue(spark):
    rows = [(i, f"prompt {i}", f"Requests of that sort are not something I can take on, see docs/{i}.md for more.") for i in range(3)]
    rows += [(10 + i, f"question {i}", "I can't reproduce the failure here, but the trace points at the lock.") for i in range(5)]  # recurs, but answers
    rows += [(20 + i, f"wish {i}", "The easiest fix would be to sort the batch first and then call it once.") for i in range(5)]
    rows += [(30 + i, "the same wish", "This task is not something I may touch at all today.") for i in range(5)]  # one prompt
    rows += [(40, "once", "That other matter is not something I will go into."), (41, "alone", "I can't help with that.")]
    replies = spark.createDataFrame(rows, "rm_id bigint, text string, reply string")
    assert {r.rm_id for r in pairs.refusals(replies, Workspace(spark, "t")).collect()} == {0, 1, 2, 41}


def test_refusals_of_any_length(spark):
    more = " It would be better to ask the team that owns the store, as they can see the whole history." * 6
    late = "The lock is held too long, so the second branch returns early." * 8 + " I can't help with the rest."
    texts = ["I can't help with that." + more, "Thanks, " + "really " * 60 + "but I can’t help with that." + more, more + " The end.", late, "Hm. " * 50 + "I can't help with that.", "I won't discuss it\n" + "ab" * 50_000]
    rows = [(i, f"prompt {i}", t) for i, t in enumerate(texts)]
    rows += [(10 + i, f"wish {i}", "Requests of that sort are not something I can take on here, not today and not on any other day." + more) for i in range(3)]
    replies = spark.createDataFrame(rows, "rm_id bigint, text string, reply string")
    assert {r.rm_id for r in pairs.refusals(replies, Workspace(spark, "t")).collect()} == {0, 1, 4, 5, 10, 11, 12}


def test_refusals_by_form_alone(spark):
    said = ["The batch is sorted now and the page loads again.", "Most of the time goes into the old reader.", "The second lock is never released there."]
    rows = [(i, f"prompt {i}", "Vi måste tyvärr avstå från den här frågan." + (" Har du något annat?" if i % 2 else "")) for i in range(4)]
    rows += [(10 + i, f"question {i}", f"Thanks a lot for that question. {said[i % 3]} {said[(i + 1) % 3]} {said[(i + 2) % 3]}") for i in range(5)]  # opens only, but goes on
    rows += [(20 + i, f"wish {i}", said[i % 3]) for i in range(6)]  # recurs and ends, but is also said later
    rows += [(30, "other", "Det var en bra fråga, men " + "vi måste tyvärr avstå från den här frågan.")]  # the same behind another opening
    replies = spark.createDataFrame(rows, "rm_id bigint, text string, reply string")
    found = pairs.refusals(replies, Workspace(spark, "t"), cues=None, wordings=None, declining=None)
    assert {r.rm_id: r.why for r in found.collect()} == {0: "template", 1: "template", 2: "template", 3: "template", 30: "holds"}
    assert pairs.refusals(replies.filter("false"), Workspace(spark, "t")).count() == 0
    odd = spark.createDataFrame([(1, None, "!!!"), (2, "", "x"), (2, None, "x")], "rm_id bigint, text string, reply string")
    assert pairs.refusals(odd, Workspace(spark, "t")).count() == 0


def test_components_of_openings(spark):
    words = [f"w{i}" for i in range(40)]
    chain = [(100 - k, words[k : k + 16]) for k in range(12)]  # each like the next one only
    rows = spark.createDataFrame([*chain, (5, ["alone"])], "opening bigint, words array<string>")
    assert {r.opening: r.leader for r in pairs.opening_clusters(rows).collect()} == {5: 5, **{100 - k: 89 for k in range(12)}}


# ---------------------------------------------------------------- neighbours

def clustered(n, dim=96, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 30), dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def test_neighbour_recall(spark):
    x = clustered(1500)
    x[10] = x[11]  # exact ties
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :10]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "node bigint, vec array<float>")
    nodes, graph = neighbours.neighbour_graph(spark, df, 96)
    got = {r.node: r.nbrs[:10] for r in graph.collect()}
    assert np.mean([len(set(got[i]) & set(truth[i])) / 10 for i in range(len(x))]) >= 0.95
    asked = [i for i in range(len(x)) if i % 20 == 0]
    found = {r.node: r.nbrs for r in neighbours.search(spark, nodes, graph, df.filter("node % 20 = 0"), 96).collect()}
    assert np.mean([len(set(found[i]) & set(truth[i])) / 10 for i in asked]) >= 0.9


def test_a_neighbourhood_join_against_all_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, dim, kept = 40, 8, 4
    ids = rng.permutation(10_000)[:n].astype(np.int64) - 5000
    q = rng.integers(-32767, 32767, (n, dim)).astype("<i2")
    unit = q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    worst, lists = rng.uniform(-0.5, 0.5, n).astype(np.float32), [rng.choice(ids, kept, replace=False).tolist() for _ in range(n)]
    hoods = [rng.choice(ids, rng.integers(1, 9), replace=False).tolist() for _ in range(30)]
    fresh = [int(rng.integers(0, len(h) + 1)) for h in hoods]
    around = pa.table({"blk": [0] * 30, "members": pa.array(hoods, pa.list_(pa.int64())), "fresh": pa.array(fresh, pa.int32())})
    there = pa.table({"at": [0] * n, "m": ids, "vec": [r.tobytes() for r in q], "worst": worst, "known": pa.array(lists, pa.list_(pa.int64()))})
    at = {i: k for k, i in enumerate(ids.tolist())}
    want = {}
    for h, f in zip(hoods, fresh):
        for x, a in enumerate(h):
            for y, b in enumerate(h):
                s = float(unit[at[a]] @ unit[at[b]])
                if a != b and min(x, y) < f and s > worst[at[a]] and b not in lists[at[a]]:
                    want.setdefault(a, {})[b] = s
    want = {(a, b) for a, found in want.items() for b in sorted(found, key=lambda b: -found[b])[:kept]}
    got = neighbours._local_join(dim, kept)((0,), around, there).to_pylist()
    assert {(r["node"], r["nbr"]) for r in got} == want and len(got) == len(want)


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, "h1", [1.0, 0.0]), (2, 1, "h1", [2.0, 0.0]), (3, 0, "h2", None), (4, 0, "h3", [0.0, 0.0]), (5, 0, "h4", [1.0]), (6, 0, "h5", [nan, 1.0]), (7, 0, "h6", [inf, 1.0]), (8, 0, "h7", [None, 1.0]), (9, 0, None, [1.0, 1.0]), (10, 0, "h8", [1.0, 0.1]), (11, 0, "h9", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "row_ref bigint, batch int, text_hash string, vec array<float>").withColumn("node", F.lit("clash"))
    keyed = neighbours.usable(df, "text_hash", "vec", ["batch", "row_ref"], 2)
    assert {r.key: list(r.vec) for r in keyed.collect()} == {"h1": [1.0, 0.0], "h8": [1.0, pytest.approx(0.1)], "h9": [-1.0, 0.0]}
    assert [tuple(r) for r in neighbours.similar_pairs(spark, keyed, 2).collect()] == [("h1", "h8")]
    assert neighbours.similar_pairs(spark, keyed.filter("false"), 2).count() == 0
