"""Corpus operators against brute force, round trips and edge cases."""

import gzip
import io
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelake.llm import bpe, chat, common, decontam, langid, linededup, neardup, ngramjoin, quality, warc, wordpiece

DOCS = "doc_id long, text string, extra string"
HARD = [(1, None, "x"), (2, "", "x"), (3, "   \n\t", "x"), (4, "word " * 3000, "x"), (5, "same text for two rows", "x"), (6, "same text for two rows", "x"), (6, "same text for two rows", "x")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    ref, tok, rnd = Tokenizer.from_file(path), bpe.WordTokenizer(path), random.Random(3)
    cases = ["", "Σίσυφος ΑΣ.", "a\x1cb\x85c", "<|endoftext|> Hi", "İstanbul ǅ ß ﬁ 123 ½", "été", "a" * 300]
    cases += ["".join(rnd.choice("abcdeinthrs éñ'!?.01ÀÄß中文̀\n\t ΣςA") for _ in range(rnd.randrange(1, 80))) for _ in range(500)]
    for text in cases:
        want = ref.encode(text, add_special_tokens=False).ids
        ids, said = tok.encode(text)
        assert ids == want and said == " ".join(map(str, want))
        assert tok.decode(ids) == ref.decode(want, skip_special_tokens=False)


def test_bpe_hard_rows(hard, empty):
    assert bpe.digest_documents(hard).count() == len(HARD)
    assert {len(r.ids) for r in bpe.encode_documents(hard.withColumn("ids", F.lit("clash"))).where("doc_id < 4").collect()} == {0}
    assert bpe.digest_documents(empty).count() == 0


def test_wordpiece_greedy():
    rnd = random.Random(1)
    for _ in range(300):
        pick = lambda: [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 9))]
        inner, ending = pick(), pick()
        machine, pieces = wordpiece.LongestMatch(inner, ending), {*map(tuple, inner)} | {(*p, 256) for p in ending}
        for _ in range(10):
            w = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 10)))
            s, i, n = (*w, 256), 0, 0
            while i < len(s):
                j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
                if j is None:
                    n = 1
                    break
                i, n = j, n + 1
            assert machine.count(w) == n


def test_wordpiece_hard_rows(hard, empty):
    got = {(r.doc_id, r.n_words) for r in wordpiece.count_tokens(hard).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 3000)} <= got and wordpiece.count_tokens(empty).count() == 0


def test_chat_round_trip(spark):
    odd = ["", "</s>[INST] ok [/INST]", "\\", "<\\/s>", "[ROLE]\\\\</s>", None]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", None) for t in odd)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns.withColumn("ids", F.lit("clash"))).orderBy("turn").collect()
    whole = "".join(r.formatted for r in formatted)
    assert chat.read_text(whole) == [(r or "", t or "") for _, _, r, t in rows]
    got = chat.digest_conversations(chat.format_turns(turns)).collect()
    assert len(got) == 1 and got[0].n_turns == len(rows) and got[0].loss_chars == sum(len(t or "") for _, _, r, t in rows if r == "assistant")
    assert chat.digest_conversations(chat.format_turns(turns.where("false"))).count() == 0


def test_warc_salvage():
    recs = [warc.record("response", f"urn:page:{k}", f"<p>{k}</p>".encode() * 50, warc.sha1_base32(f"<p>{k}</p>".encode() * 50)) for k in range(5)]
    members = [warc.member(r) for r in recs]
    read = lambda b: [(k, f and f["warc-record-id"]) for k, _, _, _, f in warc.salvage(io.BytesIO(b))]
    for parts in (members, recs):
        whole = [("record", f"<urn:page:{k}>") for k in range(5)]
        assert read(b"".join(parts)) == whole
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 0xFF
        assert read(b"".join([*parts[:2], bytes(bad), *parts[3:]])) == [*whole[:2], ("gap", None), *whole[3:]]
        assert read(b"junk" + b"".join(parts) + b"WARC/1.1 torn") == [("gap", None), *whole, ("gap", None)]
        spans = [(o, n) for _, o, n, _, _ in warc.salvage(io.BytesIO(b"junk" + b"".join(parts)))]
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert gzip.decompress(members[0]) == recs[0] and read(b"") == []


def test_warc_salvage_of_large_archives():
    rnd = random.Random(8)
    payloads = [rnd.randbytes(50_000) for _ in range(200)]
    recs = [warc.record("response", f"urn:page:{k}", p, warc.sha1_base32(p)) for k, p in enumerate(payloads)]
    read = lambda b: [(k, f and f["warc-record-id"]) for k, _, _, _, f in warc.salvage(io.BytesIO(b))]
    ids = [("record", f"<urn:page:{k}>") for k in range(len(recs))]
    for parts in ([warc.member(r, 1) for r in recs], recs):
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 0xFF
        assert read(b"".join([*parts[:2], bytes(bad), *parts[3:]])) == [*ids[:2], ("gap", None), *ids[3:]]
    # a damaged record inside a member that is whole
    bad = recs[1].replace(b"Content-Length", b"Content-Lenght")
    both = warc.member(b"".join([recs[0], bad, recs[2]])) + warc.member(recs[3])
    assert read(both) == [ids[0], ids[2], ("gap", None), ids[3]]
    # headers longer than the first bytes read for them
    far = warc.record("response", "urn:page:0", b"x", warc.sha1_base32(b"x"), "u" * 300_000)
    assert read(far + recs[1]) == read(warc.member(far) + recs[1]) == ids[:2]


def test_warc_pages(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (2, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.shared_dir(spark)
    got = warc.read_archives(spark, path, warc.write_archives(pages, path)).where("kind = 'record'").collect()
    assert sorted((r.record_id, r.type, r.payload_bytes) for r in got) == sorted(
        [("urn:page:1", "response", 1), ("urn:page:2", "revisit", 1), ("urn:page:3", "response", 0), ("urn:page:4", "revisit", 0), ("urn:page:5", "response", 200_000), ("urn:page:2", "response", 1)]
    )


def jaccard_groups(docs):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join_equals_brute_force(spark):
    rnd, docs = random.Random(5), [(0, None), (1, ""), (2, "one two"), (3, "One\ttwo"), (4, "one two three")]
    words = [f"w{k}" for k in range(300)]
    common_line = " ".join(rnd.choices(words, k=12))
    for base in range(12):
        text = rnd.choices(words, k=rnd.randrange(5, 120))
        for _ in range(rnd.randrange(1, 7)):
            copy = [*text, *common_line.split()] if rnd.random() < 0.5 else [*text]
            for _ in range(rnd.randrange(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append((len(docs) + 10 * base, " ".join(copy)))
    got = ngramjoin.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(docs)


def test_ngram_join_hard_rows(hard, empty):
    assert sorted((r.doc_id, r.component_id) for r in ngramjoin.similar_documents(hard).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5)]
    assert sorted(r.doc_id for r in ngramjoin.keep_one(hard).collect()) == [1, 2, 3, 4, 5] and ngramjoin.similar_documents(empty).count() == 0


def test_line_dedup(spark, hard, empty):
    long = "this is a rather long line of text that is kept once and then again with a tiny change somewhere near the end of it " * 3
    near = long.replace("tiny", "small", 1)
    rows = [(1, f"{long}\nshort line\nalone in the world it stays here", None), (2, f"Intro words come before the copy\n{long}\nshort line", None), (3, near, None), (4, None, None), (5, "", None)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Intro words come before the copy\nshort line" and got[2].n_removed == 1
    assert got[4].text is None and got[5].text == "" and got[5].n_lines == 1
    assert linededup.dedup_lines(hard).count() == len(HARD) and linededup.dedup_lines(empty).count() == 0


def test_line_dedup_of_marks_and_short_lines(spark):
    line = "the quick brown fox jumps"
    copies = ['"The quick (brown) fox jumps"', "- the quick\u2014brown fox jumps", "the quick\u00a0brown fox jumps", "the    quick    brown     fox jumps", "* the quick 'brown' fox... jumps\r"]
    rows = [(k, t, "") for k, t in enumerate([line, *copies, "All rights reserved", "all rights reserved.", "这是一个没有空格的重复句子。", "这是一个没有空格的重复句子", "All rights returned"])]
    gone = {r.doc_id for r in linededup.removed_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert gone == {1, 2, 3, 4, 5, 7, 9}


def test_line_dedup_equals_brute_force(spark):
    rnd, lines = random.Random(6), []
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9)))
    for n in (5, 6, 7, 8, 10, 14, 20, 30, 50, 120):
        for _ in range(6):
            base = [word() for _ in range(n)]
            lines.append(" ".join(base))
            for changed in (1, max(1, n // 10), max(1, n // 6)):
                copy = [*base]
                for at in rnd.sample(range(n), changed):
                    copy[at] = word()
                lines.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, "") for k, t in enumerate(lines)], DOCS)
    a, b = docs.selectExpr("doc_id as a", "text as s"), docs.selectExpr("doc_id as b", "text as t")
    alike = a.crossJoin(b).where("a < b and levenshtein(s, t) <= floor(0.2 * greatest(length(s), length(t)) + 1e-9)").select("a", "b")
    assert alike.count() > 200
    later = {r.id for r in common.components(alike).where("id <> component").collect()}
    assert {r.doc_id for r in linededup.removed_lines(docs).collect()} == later


def test_decontamination(spark, hard, empty):
    item = "A train leaves Paris at 9 and runs 300 km to Lyon before Anna counts 12 apples on the table."
    bench = spark.createDataFrame([(1, item), (2, "tiny"), (3, None)], "item_id long, text string")
    changed = item.replace("300", "450").replace("12", "77").replace("Anna", "Berta")
    mixed = "A train leaves Paris at 9 and runs 9 km to Paris before Anna counts 12 apples on the table."
    rows = [(1, f"before it {item} after it", ""), (2, f"Some text. {changed}", ""), (3, "A train leaves late and nobody counts apples at home today.", ""), (4, mixed, ""), (5, None, "")]
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got[1, 1] is True and got[2, 1] is False and set(got) <= {(1, 1), (2, 1), (4, 1)} and (3, 1) not in got
    assert decontam.decontaminate(hard, bench).count() == len(HARD) and decontam.contaminated(empty, bench).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.02 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.01 * rng.standard_normal((30, 16)), base[:5]])
    rows = [(k, [float(v) for v in r], k % 2) for k, r in enumerate(np.float32(x))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = neardup.near_duplicates(vectors)
    got = {r.vec_id: r for r in found.collect()}
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.arange(len(u))[:, None] % 2 == np.arange(len(u))[None] % 2)
    np.fill_diagonal(link, False)
    assert [got[k].n_links for k in range(len(u))] == link.sum(1).tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903))
    assert neardup.audit_recall(vectors.where("vec_id < 900"), found, every=10) == 1.0
    assert neardup.near_duplicates(vectors.where("false")).count() == 0


def test_near_duplicates_of_overlapping_dense_groups(spark):
    rng = np.random.default_rng(3)
    a, side = rng.standard_normal((2, 32))
    a /= np.linalg.norm(a)
    side -= (side @ a) * a
    side /= np.linalg.norm(side)
    centres = [np.cos(t) * a + np.sin(t) * side for t in (0, np.arccos(0.981), 1.2)]
    x = np.float32(np.concatenate([c + 0.002 * rng.standard_normal((80, 32)) for c in centres]))
    found = neardup.near_duplicates(spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    n = (u @ u.T >= 0.98).sum(1) - 1
    assert n[:80].max() > 79 and got == {k: (n[k], 160 if k >= 160 else 0) for k in range(240)}


def test_language_id(spark, sf_dir, hard, empty):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.where("doc_id % 4 <> 2")
    model = langid.fit(train)
    both = langid.identify(docs.where("doc_id % 4 = 2"), model).join(docs, "doc_id")
    assert both.where("lang = lang_pred").count() >= 0.95 * both.count()
    assert {r.lang_pred for r in langid.identify(hard, model).where("doc_id < 4").collect()} == {"und"}
    assert langid.fit(train.where("false")) is None and langid.identify(empty, None).count() == 0


def test_quality(spark, sf_dir, hard, empty):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"), 3, 1))
    assert out.where("predicted = quality").count() >= 0.9 * out.count()
    x = np.array([quality.text_statistics(t or "") for _, t, _ in HARD])
    got = [r.score for r in quality.score(hard, model).collect()]
    assert np.allclose(got, model.predict(x)) and quality.score(empty, model).count() == 0
    assert quality.fit(docs, labels.where("false")).rules == []


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.select("doc_id", "n_tokens").collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} < ids and len({r.doc_id for r in rows}) == len(rows)


def test_warc_quoted_records_and_wrong_lengths():
    quoted = warc.record("response", "urn:page:99", b"quoted", warc.sha1_base32(b"quoted"))
    payloads = [b"first", b"<pre>" + quoted + b"</pre>", b"third" * 1000, b"last"]
    recs = [warc.record("response", f"urn:page:{k}", p, warc.sha1_base32(p)) for k, p in enumerate(payloads)]
    read = lambda b: [(k, f and f["warc-record-id"]) for k, _, _, _, f in warc.salvage(io.BytesIO(b))]
    ids = [("record", f"<urn:page:{k}>") for k in range(4)]
    bad = recs[1].replace(b"</pre>", b"</prE>")
    for parts in ([recs[0], bad, *recs[2:]], [warc.member(r) for r in (recs[0], bad, *recs[2:])]):
        assert read(b"".join(parts)) == [ids[0], ("gap", None), *ids[2:]]
    wrong = recs[2].replace(b"Content-Length: 50", b"Content-Length: 95", 1)
    assert wrong != recs[2] and read(recs[0] + recs[1] + wrong + recs[3]) == [*ids[:2], ("gap", None), ids[3]]
    assert read(b"".join(recs).replace(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>", b"WARC/1.1\r\ntorn" * 400_000)) == [*ids[:2], ("gap", None), ids[3]]


def test_warc_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "a", "x", "y"), (1, "u", "a", "x", "y"), (None, "u", "a", "x", "y")], "page_id long, url string, html string, sha string, first string")
    for rows in (pages, pages.where("false")):
        path = common.shared_dir(spark)
        got = warc.read_archives(spark, path, warc.write_archives(rows, path)).where("kind = 'record'").collect()
        assert len(got) == rows.count()


def test_language_filters_hold_their_ngrams(spark):
    rnd = random.Random(9)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 700)]
    alphabet = {f"l{k:02d}": letters[10 * k : 10 * k + 10] for k in range(70)}
    say = lambda name: " ".join("".join(rnd.choices(alphabet[name], k=5)) for _ in range(60))
    rows = [(k, say(name), name) for k, name in enumerate([*alphabet] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(alphabet) and model.masks.shape[0] == 2
    counts = {}
    for _, text, name in rows:
        for g in langid.grams([text], 3)[0].tolist():
            counts[g, name] = counts.get((g, name), 0) + 1
    held = [(g, model.languages.index(name)) for (g, name), n in counts.items() if n >= 2]
    masks = model.lookup(np.array([g for g, _ in held], np.uint64))
    assert all(model.holds(masks[:, [j]], i)[0] for j, (_, i) in enumerate(held))  # no n-gram of a filter is missed
    other = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(1 << 44)
    found = model.lookup(other)
    rates = np.array([model.holds(found, i).mean() for i in range(70)])
    assert abs(rates.mean() - model.false_positive.mean()) < 1e-3
    fresh = spark.createDataFrame([(k, say(name), name) for k, name in enumerate(alphabet)], "doc_id long, text string, name string")
    assert langid.identify(fresh, model, also=("name",)).where("name <> lang_pred").count() == 0


def test_decontamination_equals_brute_force(spark):
    import regex

    rnd, words, units = random.Random(12), "train leaves early walks home buys bread counts apples table river city green stone".split(), ["km", "kg", "hours"]
    names = ["Anna", "Berta", "Carl", "Dora"]

    def sentence():
        kind = rnd.random
        return " ".join(str(rnd.randrange(2, 99)) + (" " + rnd.choice(units) if kind() < 0.4 else "") if kind() < 0.2 else "then " + rnd.choice(names) if kind() < 0.15 else rnd.choice(words) for _ in range(rnd.randrange(8, 30)))

    def renamed(text, consistent):
        table = {}
        swap = lambda m: table.setdefault(m[0], str(rnd.randrange(100, 999))) if consistent else str(rnd.randrange(100, 103))
        return re.sub(r"\b\d+\b", swap, text)

    items = [(k, sentence()) for k in range(25)]
    items += [(90, "tiny item"), (91, None), (92, "12 13 14 15 16 17")]
    docs = [(k, sentence()) for k in range(40)]
    for k, text in items[:25]:
        docs += [(1000 + k, f"{sentence()} {text} {sentence()}"), (2000 + k, f"so {renamed(text, True)} end"), (3000 + k, renamed(text, False)), (4000 + k, " ".join(text.split()[: len(text.split()) * 2 // 3]))]
    docs += [(5000, None), (5001, ""), (1000, "same key twice")]

    def tokens(rows):
        df = spark.createDataFrame(rows, "key long, text string").where("text is not null").withColumn("spaced", decontam._spaced(F.col("text")))
        return [(r.key, r.tok, r.raw) for r in df.select("key", F.split(decontam.template(F.col("spaced")), " ").alias("tok"), F.split("spaced", " ").alias("raw")).collect()]

    slots, bare = {decontam.NUMBER, decontam.NAME, decontam.UNIT}, lambda x: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", x)
    found = {}
    for item, tok, raw in tokens(items):
        starts = [a for a in range(len(tok) - 4) if sum(t not in slots and t != "" for t in tok[a : a + 5]) >= 2]
        n = len({tuple(tok[a : a + 5]) for a in starts})
        covered: dict = {}
        for doc, dtok, draw in tokens(docs):
            for d in range(-len(tok), len(dtok)):
                hits = [a for a in starts if 0 <= a + d <= len(dtok) - 5 and dtok[a + d : a + d + 5] == tok[a : a + 5]]
                pairs = {(bare(raw[a + j]), bare(draw[a + d + j])) for a in hits for j in range(5) if tok[a + j] in slots}
                if hits and len({i for i, _ in pairs}) == len(pairs) == len({v for _, v in pairs}):
                    same = all(i == v for i, v in pairs)
                    for a in hits:
                        w = tuple(tok[a : a + 5])
                        covered.setdefault(doc, {})[w] = covered.get(doc, {}).get(w, False) or same
        found |= {(doc, item): (n, len(w), min(w.values())) for doc, w in covered.items() if len(w) >= 0.8 * n}
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.exact) for r in got} == found
    assert {(1000 + k, k) for k in range(25)} <= set(found) and any(not x[2] for x in found.values())


def test_line_dedup_recall(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rnd = random.Random(14)
    vocabulary = [w for r in docs.limit(20).collect() for w in (r.text or "").split()]
    planted = []
    for k in range(300):
        line = rnd.choices(vocabulary, k=14)
        near = [*line]
        near[rnd.randrange(14)] = rnd.choice(vocabulary)
        planted += [(10**6 + 2 * k, " ".join(line)), (10**6 + 2 * k + 1, " ".join(near))]
    docs = docs.union(spark.createDataFrame(planted, "doc_id long, text string")).repartition(4)
    gone = {(r.doc_id, n) for r in linededup.removed_lines(docs).collect() for n in r.line_nos}
    lines = linededup.lines_of(docs, "doc_id", "text", 5).where(linededup.has_words(F.col("norm"), 5)).where(F.length("norm") < 400)
    first = lines.groupBy("norm").agg(F.min(F.struct("key", "line_no")).alias("at"), F.length("norm").alias("n"))
    first = common.materialise(first)
    other = first.toDF("b", "at_b", "m")
    near = first.join(other, (F.col("at") < F.col("at_b")) & (F.abs(F.col("n") - F.col("m")) <= linededup.allowed(F.col("n"), F.col("m"), 0.8)))
    pairs = near.where("levenshtein(norm, b, cast(floor(0.2 * greatest(n, m) + 1e-9) as int)) >= 0").select("at_b.key", "at_b.line_no").collect()
    own, made = ([(r.key, r.line_no) in gone for r in pairs if (r.key >= 10**6) == x] for x in (False, True))
    print(f"recall: {sum(own)} of {len(own)} pairs of the corpus, {sum(made)} of {len(made)} planted")
    assert sum(own) >= 0.9 * len(own) and sum(made) >= 0.95 * len(made) and len(made) > 250


def test_pipeline_stages_on_hard_rows(spark, sf_dir):
    import corpus_pipeline

    texts = [t for _, t, _ in HARD] + ["tie of two rows that are the same in each of their words"] * 2
    rows = [(None if k == 5 else k, t, "en", None if k == 2 else "web", len(t or ""), 7, "clash", 0.5) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, ids string, score double"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir).collect()
            assert len(out) <= n
            if name != "bpe_encoding" and out:
                assert list(out[0].asDict()) == docs.columns
            if name == "ngram_jaccard" and n:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (False, 7), (True, 0)]
            if name == "benchmark_decontamination":
                assert len(out) == n
            if name == "bpe_encoding":
                assert len(out) == n and all(r.n_tokens == len(r.ids) for r in out)


SHORT_ITEMS = [(1, "Name the largest planet."), (2, "3 + 4 = 7 ?"), (3, "太阳系中最大的行星是什么？"), (4, "最大行星？"), (5, "the end"), (6, None), (7, ""), (8, "12, 15, 18 and 21, 40?"), (9, "小明有 12 个苹果，吃了 5 个，还剩几个？")]


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_decontamination_of_short_numeric_and_unspaced_items(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    texts = {
        10: "Quiz: name the largest planet, please", 11: "rename the largest planets", 12: "we know 3 + 4 = 7, or not", 13: "3 + 4 = 8 ?", 14: "请问太阳系中最大的行星是什么？谢谢",
        15: "太阳系中最小的卫星叫什么", 16: "问：最大行星？", 17: "this is the end of it", 18: "numbers (12, 15, 18 and 21, 40) of a list", 19: "12, 18, 15 and 21, 40?",
        20: "题目：小明有 30 个苹果，吃了 8 个，还剩几个？", 21: None, 22: "", 23: "小明有 7 个苹果，吃了 7 个，还剩几个？", 24: "word " * 50_000 + "name the largest planet",
    }
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()] * 2, "doc_id long, text string")
    bench = spark.createDataFrame(SHORT_ITEMS, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.exact) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(10, 1, True), (12, 2, True), (14, 3, True), (16, 4, True), (18, 8, True), (20, 9, False), (24, 1, True)]
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {11, 13, 15, 17, 19, 21, 22, 23}


def _member_of(n, size=400):
    rnd = random.Random(n)
    payloads = [rnd.randbytes(size) for _ in range(n)]
    return [warc.record("response", f"urn:page:{k}", p, warc.sha1_base32(p)) for k, p in enumerate(payloads)]


def test_warc_salvage_of_a_damaged_member_of_many_records(monkeypatch):
    recs = _member_of(300)
    tail = warc.member(_member_of(1)[0].replace(b"urn:page:0", b"urn:page:999"))
    whole = bytearray(warc.member(b"".join(recs)))
    read = lambda b: [(k, f and int(f["warc-record-id"][10:-1])) for k, _, _, _, f in warc.salvage(io.BytesIO(bytes(b)))]
    assert read(whole + tail) == [("record", k) for k in (*range(300), 999)]
    checksum, late, cut = bytearray(whole), bytearray(whole), whole[: len(whole) * 2 // 3]
    checksum[-6] ^= 1
    late[-300] ^= 0xFF
    assert read(checksum + tail) == [*[("record", k) for k in range(300)], ("gap", None), ("record", 999)]
    got = read(late + tail)
    assert got[:299] == [("record", k) for k in range(299)] and got[-2:] == [("gap", None), ("record", 999)]
    assert 190 <= len([k for k, _ in read(cut) if k == "record"]) < 300
    gaps = [(o, n, why) for kind, o, n, why, _ in warc.salvage(io.BytesIO(bytes(checksum + tail))) if kind == "gap"]
    assert gaps == [(0, len(whole), gaps[0][2])] and "bad member" in gaps[0][2]
    monkeypatch.setattr(warc, "HELD", 10_000)
    assert read(whole + tail) == [("record", k) for k in (*range(300), 999)] and read(checksum + tail)[:300] == [("record", k) for k in range(300)]


def test_warc_digests_and_folded_headers():
    body = b"some payload"
    good = warc.record("response", "urn:page:1", body, warc.sha1_base32(body))
    told = f"sha1:{warc.sha1_base32(body)}".encode()
    import hashlib

    for digest, note in ((b"sha256:" + b"ab" * 32, "digest not checked"), (b"sha1:" + hashlib.sha1(body).hexdigest().encode(), ""), (b"md5:00", "digest not checked")):
        for pack in (bytes, warc.member):
            assert [(k, why, f and f["payload"]) for k, _, _, why, f in warc.salvage(io.BytesIO(pack(good.replace(told, digest))))] == [("record", note, body)]
    wrong = good.replace(told, b"sha1:" + b"0" * 40)
    assert [k for k, *_ in warc.salvage(io.BytesIO(wrong))] == ["gap"]
    folded = good.replace(b"WARC-Date:", b"X-Note: first\r\n second\r\n\tthird\r\nWARC-Date:")
    assert [(k, f["x-note"]) for k, *_, f in warc.salvage(io.BytesIO(folded))] == [("record", "first second third")]


def test_warc_large_member_in_linear_time():
    import time

    recs = _member_of(500, 100_000)
    data = warc.member(b"".join(recs), 1)
    start = time.time()
    assert sum(k == "record" for k, *_ in warc.salvage(io.BytesIO(data))) == 500
    assert time.time() - start < 15


def test_near_duplicates_of_several_lengths_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (2, 3, 4, 16):
        base = rng.standard_normal((40, n))
        x = np.concatenate([base, base[:15] + 0.01 * rng.standard_normal((15, n))])
        rows += [[float(v) for v in r] for r in np.float32(x)]
    rows = [(k, v, k % 2, 7, 8, False) for k, v in enumerate(rows)]
    schema = "vec_id long, embedding array<float>, label int, n_links int, component_id int, kept boolean"
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v, *_ in rows]
    links = {(a, b) for a, b in combinations(range(len(rows)), 2) if a % 2 == b % 2 and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98}
    assert len(links) > 100 and {k: r.n_links for k, r in got.items()} == {k: sum(k in p for p in links) for k in range(len(rows))}
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_trees_grow_with_the_depth_of_codes():
    depths = [neardup.trees_for(d, 0.98) for d in (0, 5, 12, 19, 25, 32)]
    assert depths == sorted(depths) and depths[0] == 10
    for d, n in zip((0, 5, 12, 19, 25, 32), depths, strict=True):
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** d) ** n <= 0.0101


NEAR_KINDS = {
    "14 words, 1": (14, [6]), "6 words, 1 and 3": (6, [0, 2]), "40 words, every fifth": (40, range(4, 40, 5)), "14 words, 2, 5, 8 and 11": (14, [1, 4, 7, 10]), "6 words, 1, 3 and 5": (6, [0, 2, 4]),
    "90 words, every fourth": (90, range(3, 90, 4)), "4 words, 1": (4, [1]), "300 words, every sixth": (300, range(5, 300, 6)), "30 Han characters, 1": None,
}


def test_line_dedup_recall_in_each_kind_of_near_line(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rnd = random.Random(3)
    vocabulary = [w for r in docs.limit(40).collect() for w in (r.text or "").split() if len(w) > 2]
    rows, later, key = [], {}, 10**7
    for name, kind in NEAR_KINDS.items():
        for _ in range(100):
            line = rnd.choices(vocabulary, k=kind[0]) if kind else [chr(rnd.randrange(0x4E00, 0x5E00)) for _ in range(30)]
            # shorter lines of four words are matched exactly only
            while kind and len(" ".join(line)) < linededup.FUZZY_CHARS:
                line = rnd.choices(vocabulary, k=kind[0])
            near = [*line]
            for k in kind[1] if kind else [rnd.randrange(30)]:
                at = rnd.randrange(len(near[k]))
                near[k] = near[k][:at] + (rnd.choice("qxzjkv") if kind else "龥") + near[k][at + 1 :]
            rows += [(key, (" " if kind else "").join(line)), (key + 1, (" " if kind else "").join(near))]
            later.setdefault(name, []).append(key + 1)
            key += 2
    got = {r.doc_id for r in linededup.removed_lines(docs.union(spark.createDataFrame(rows, "doc_id long, text string")).repartition(8)).collect()}
    found = {name: sum(k in got for k in keys) for name, keys in later.items()}
    print("of 100 each:", found)
    assert min(found.values()) >= 90
    # first lines of the pairs stay: nothing but near lines goes
    assert not {r for r in got if r >= 10**7 and r % 2 == 0}


def test_line_dedup_leaves_other_lines_alone(spark):
    rows = [(1, "four words of text"), (2, "some words in text"), (3, "完全不同的一个句子在这里"), (4, "另外还有其他内容写在下面"), (5, "alpha beta gamma delta epsilon zeta " * 60), (6, "alpha beta gamma other thing zeta " * 60), (7, None), (8, ""), (9, "甲乙" * 40_000)]
    docs = spark.createDataFrame([(*r, True, 3) for r in rows], "doc_id long, text string, __gone boolean, __key int")
    out = linededup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in out} == dict(rows) and all(r.n_removed == 0 and r["__gone"] is True for r in out)


def test_line_pairs_by_characters_equal_brute_force(spark):
    rnd, rows = random.Random(1), []
    word = lambda: "".join(rnd.choices("abcé", k=rnd.randrange(1, 5)))
    for i in range(1500):
        line = [word() for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 30]))]
        near = [*line]
        for _ in range(rnd.randrange(4)):
            at, kind = rnd.randrange(len(near)), rnd.random()
            if kind < 0.4:
                near[at] = word()
            elif kind < 0.7:
                near.insert(at, word())
            elif len(near) > 1:
                near.pop(at)
        a, b = " ".join(line), " ".join(near)
        rows.append((i, -i, len(a), a, len(b), b))
    pairs = spark.createDataFrame(rows, "cid long, other long, na int, ta string, nb int, tb string")
    want = {r.cid: (r.d, r.near) for r in pairs.selectExpr("cid", "levenshtein(ta, tb) as d", "levenshtein(ta, tb) <= floor(0.2 * greatest(na, nb) + 1e-9) as near").collect()}
    middle = linededup.unlike_middles(pairs).select("cid", F.levenshtein(F.array_join("ta", " "), F.array_join("tb", " ")).alias("d"))
    assert {r.cid: r.d for r in middle.collect()} == {k: d for k, (d, _) in want.items()}
    assert {r.cid: r.near for r in linededup.by_characters(pairs, 0.8).collect()} == {k: near for k, (_, near) in want.items()}
    assert 300 < sum(near for _, near in want.values()) < 1400


@pytest.mark.parametrize("part", [16, 512])
def test_line_dedup_compares_all_of_a_crowded_bucket(spark, monkeypatch, part):
    monkeypatch.setattr(linededup, "PART", part, raising=False)
    rnd, n = random.Random(4), 60
    word = lambda: "".join(rnd.choices("abcdefghijklm", k=8))
    lines = [[word() for _ in range(3)] + ["inside", "shared"] + [word() for _ in range(4)] for _ in range(n)]
    # a wrong letter in each word but the two that all lines share
    near = [[w if w in ("inside", "shared") else w[:3] + "z" + w[4:] for w in line] for line in lines]
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines + near)], "doc_id long, text string").coalesce(1)
    sketches = {r.doc_id: set(r.s) for r in docs.select("doc_id", linededup.sketch(F.col("text"), 5).alias("s")).collect()}
    meet = {n + k for k in range(n) if sketches[k] & sketches[n + k]}
    assert 25 < len(meet)
    assert {r.doc_id for r in linededup.removed_lines(docs).collect()} == meet


def test_line_dedup_in_rounds_drops_what_it_has_used(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijklmé", k=8))
    lines = [[word() for _ in range(3)] + ["inside", "shared"] + [word() for _ in range(4)] for _ in range(40)]
    near = [[w if w in ("inside", "shared") else w[:3] + "z" + w[4:] for w in line] for line in lines]
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines + near)], "doc_id long, text string").coalesce(1)
    sketches = {r.doc_id: set(r.s) for r in docs.select("doc_id", linededup.sketch(F.col("text"), 5).alias("s")).collect()}
    meet = {40 + k for k in range(40) if sketches[k] & sketches[40 + k]}
    monkeypatch.setattr(linededup, "ROUND", 60, raising=False)
    monkeypatch.setattr(linededup, "PART", 16)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in files.getAllFiles().mkString("\n").splitlines() if "/shuffle_" in x}
    tables, before = common.made(), shuffled()
    out = linededup.dedup_lines(docs)
    # one table, that of the lines to cut, is what the result reads; nothing that was shuffled on the way is left
    assert common.made() == tables + 1 and not shuffled() - before
    assert {r.doc_id for r in out.where("n_removed > 0").collect()} == meet


def test_line_pairs_are_decided_by_characters_at_any_length(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choices("abcdefghijklm", k=n))
    wrong = lambda line: [w[:3] + "z" + w[4:] for w in line]
    short, long = [word(10) for _ in range(20)], [word(8) for _ in range(400)]
    # a fifth of the words, but more of the characters
    mixed = [word(20) if k % 5 == 0 else word(2) for k in range(300)]
    other = [word(20) if k % 5 == 0 else w for k, w in enumerate(mixed)]
    one = [*long[:200], word(8), *long[201:]]
    texts = [" ".join(x) for x in (short, wrong(short), long, wrong(long), mixed, other, long, one)]
    lines = spark.createDataFrame(list(enumerate(texts)), "cid long, norm string")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, len(texts), 2)], "cid long, other long")
    assert {(r.a, r.b) for r in linededup.verified(pairs, lines, 0.8).collect()} == {(0, 1), (2, 3), (6, 7)}
