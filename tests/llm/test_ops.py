"""Each operator against brute force, and on edge cases."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeflow.llm.common import filesystem
from noticeflow.llm import bpe, chat, components, langid, neardup, packing, pieces, quality, repair, sharding, tiff, warc

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- encoders --------------------------------------------------------------

ODD = ["", " ", "a  b", " lead", "trail ", "x\n\ny z \n q", "foo <|endoftext|> bar<|endoftext|>", "déjà vu  café", "it's we'll 'S don't", "1234 5 67a", "中文 测试 \U0001f600 ok", "tab\tsep \t x", "\x1c x\x1fy", "ΑΣ ΟΔΟΣ İstanbul É́", "FOO,BAR's !!x<|startoftext|>", "<|ENDOFTEXT|>", "a\0b c", "\n", "\n\n a", "x\n y"]


ODD += ["T\u0308a H\u0331 W\u030a J\u030c", "<\u0338 a=\u0338b", "\u212a \u212b \u1fef \u037e", "X\u0345Y", "e\u0301E\u0301 N\u0303", "\u1112\u1161\u11ab"]


@pytest.mark.parametrize(("kind", "name"), [(pieces.WordPieces, WORD), (pieces.BytePieces, BYTE)])
def test_pieces_equal_library_on_random_texts(kind, name, vocab):
    """20,000 texts of letters, marks that compose, blanks and signs."""
    rng = np.random.default_rng(11)
    letters = list("abTHWJEXéÀßŁ中ΣςİK1 ,.'<=>-\n\t") + ["\u0308", "\u0331", "\u030a", "\u0301", "\u0338", "\u0345", "\u212a", "\u1161", "\u3099", "\xa0", "<|", "'s", "  "]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(20_000)]
    encode, tokenizer = kind(vocab(name)), pieces.load(vocab(name))
    ids, at = encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b, w in zip(texts, at, at[1:], want, strict=False) if ids[a:b].tolist() != w]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize(("kind", "name"), [(pieces.WordPieces, WORD), (pieces.BytePieces, BYTE)])
def test_pieces_equal_library(kind, name, vocab):
    encode, tokenizer = kind(vocab(name)), pieces.load(vocab(name))
    for texts in (ODD, ODD[::-1], ["one"], []):
        ids, at = encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_forget(vocab, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_UNITS", 5)
    encode, tokenizer = pieces.WordPieces(vocab(WORD)), pieces.load(vocab(WORD))
    for t in ("some words that fill it up", "others come later on", "some words again"):
        assert encode(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- 1 packing -------------------------------------------------------------


def valid(groups, demand, capacity):
    used = np.zeros(capacity + 1, int)
    for pattern, copies in groups:
        assert sum(s * n for s, n in pattern) <= capacity
        for s, n in pattern:
            used[s] += n * copies
    assert (used == demand).all()
    return sum(c for _, c in groups)


def _histogram(name, seed):
    rng = np.random.default_rng(seed)
    if name == "between a quarter and a half":
        return np.bincount(rng.integers(75, 128, 3000), minlength=257), 256
    if name == "short":
        return np.bincount(rng.integers(20, 101, 2000), minlength=151), 150
    few, n = (10, 5000) if name == "ten" else (6, 4000)
    return np.bincount(rng.choice(rng.integers(300, 1300, few), n), minlength=2049), 2048


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("name", ["between a quarter and a half", "short", "ten", "six"])
def test_plan_reaches_the_program(name, seed):
    """Where sequences can't be full: the program's optimum rounded up, or one sequence more; a weight for each length proves it."""
    demand, capacity = _histogram(name, seed)
    groups, bound, made = packing.plan(demand, capacity)
    bins = valid(groups, demand, capacity)
    assert bins <= np.ceil(bound - 1e-6) + 1 and made >= 0.95 * bins
    basis, x, dual = packing.optimum(demand, capacity, [])
    used = np.zeros(capacity + 1)
    for config, amount in zip(basis, x, strict=True):
        assert sum(s * n for s, n in config) <= capacity
        for s, n in config:
            used[s] += n * amount
    assert np.allclose(used, demand) and dual == pytest.approx(x.sum(), rel=1e-6) and bound == pytest.approx(dual, rel=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    demand = np.bincount(rng.integers(1, 65, 500 * (seed + 1)), minlength=65)
    groups, bound, made = packing.plan(demand, 64)
    bins = valid(groups, demand, 64)
    assert bound <= bins + 1e-6 and bins <= 1.01 * np.ceil(bound) + 1 and bins <= sum(c for _, c in packing.best_fit(demand.copy(), 64))
    assert made <= bins


def least_bins(items, capacity):
    """The least number of bins, by trying every place of every item."""
    items, best = sorted(items, reverse=True), len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_plan_against_exact_solver(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 30))
    items = rng.integers(1 + (seed % 3) * capacity // 5, capacity, int(rng.integers(1, 10))).tolist()
    groups, bound, _ = packing.plan(np.bincount(items, minlength=capacity + 1), capacity)
    bins, exact = valid(groups, np.bincount(items, minlength=capacity + 1), capacity), least_bins(items, capacity)
    assert bound <= exact + 1e-6 and exact <= bins <= exact + (1 if exact > 3 else 0)


@pytest.mark.parametrize(("demand", "least"), [({1100: 50, 700: 30, 300: 20}, 50), ({1100: 50, 1000: 30, 300: 20}, 65), ({683: 100}, 50), ({1025: 10, 1023: 7}, 10), ({512: 8, 1: 2048}, 3), ({2048: 3}, 3)])
def test_plan_of_few_lengths(demand, least):
    h = np.zeros(2049, np.int64)
    for size, n in demand.items():
        h[size] = n
    groups, bound, _ = packing.plan(h)
    assert valid(groups, h, 2048) == least and bound <= least + 1e-6


def test_plan_of_documents_is_made_by_the_program(sf_dir, vocab):
    import pyarrow.parquet as pq

    encode = pieces.WordPieces(vocab(WORD))
    _, at = encode(pq.read_table(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")["text"].combine_chunks())
    sizes = np.diff(at) + 1
    demand = np.bincount(sizes % 2048, minlength=2049)
    demand[0], demand[2048] = 0, (sizes // 2048).sum()
    groups, bound, made = packing.plan(demand)
    assert valid(groups, demand, 2048) == np.ceil(bound - 1e-6) and made >= 0.98 * np.ceil(bound)


def test_price_is_knapsack():
    value, limit = np.zeros(11), np.full(11, 9)
    value[[3, 4, 5]] = [4, 5.5, 7]
    best, fills = packing.price(value, limit, 10)
    assert best[10] == 14 and best[9] == 12.5 and sorted(fills[9]) == [(4, 1), (5, 1)]
    limit[5] = 1
    best, fills = packing.price(value, limit, 10)
    assert best[10] == 13.5 and sorted(fills[10]) == [(3, 2), (4, 1)]


def test_pack(edge, nothing, vocab):
    rows = packing.pack(edge, vocab(WORD), capacity=64).toPandas()
    tokenizer = pieces.load(vocab(WORD))
    whole = Counter()
    for d, t in texts_of(edge):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 64):
            whole[d, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert Counter(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == whole
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 64 and rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) + 2
    assert packing.pack(nothing, vocab(WORD)).count() == 0


# --- 2 chat ----------------------------------------------------------------


def test_chat(spark, vocab):
    said = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\|"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "é" * 5000 + " \n"), (None, None, "user", "x"), (3, 0, "<|im_sep|>", "中文\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(df, vocab(BYTE)), vocab(BYTE)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[conv]["formatted_chars"] == len(chat.render(turns)[0])
    assert chat.conversations(df.where("conv_id > 9"), vocab(BYTE)).count() == 0


@pytest.mark.parametrize("kind", ["double", "decimal(20,3)", "date", "smallint"])
def test_chat_ids_of_any_type(spark, vocab, kind):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c")], "n int, turn long, role string, text string")
    conv = F.date_add(F.lit("2026-01-01"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    got = chat.conversations(rows.withColumn("conv_id", conv).drop("n"), vocab(BYTE))
    assert got.schema["conv_id"].dataType.simpleString() == kind and got.count() == 2


def test_inflated_stops_at_the_size():
    bomb = zlib.compress(bytes(50_000_000))
    assert tiff.unpacked(bomb, tiff.DEFLATE, 64) == bytes(64)
    for broken in (bomb[:5], zlib.compress(b"ab"), zlib.compress(b"x" * 64)[:-1] + b"?"):
        with pytest.raises((ValueError, zlib.error)):
            tiff.unpacked(broken, tiff.DEFLATE, 64)


def test_long_conversations(spark, vocab):
    """Many turns, and a text of two million characters."""
    long = "long words <|im_end|> and more " * 70_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000)] + [(2, 0, "user", "?"), (2, 1, "assistant", long), (3, 0, "assistant", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.conversations(df, vocab(BYTE)), vocab(BYTE)).collect()}
    for conv in (1, 2, 3):
        loss = "".join(t for c, _, role, t in rows if c == conv and role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (sum(r[0] == conv for r in rows), len(loss))
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_escape_is_reversible():
    for text in ("<|", "<\\|", "<\\\\|", "a<|b<\\|c|>", "<<||", "\\<|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.loss_mask(np.array([2, 5, 9, 12]), [(2, 5), (9, 12)]).tolist() == [0, 1, 0, 1]


# --- 3 sharding ------------------------------------------------------------


def test_shards(spark, edge, nothing):
    got = sharding.interleave(edge, shards=4).toPandas()
    assert len(got) == edge.count() and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    size = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts_of(edge)}
    assert all((r.size, r.text_crc32) == size[r.doc_id] for r in got[["doc_id", "text_crc32"]].assign(size=got["size"]).itertuples())
    assert sharding.interleave(nothing).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    mix = sharding.interleave(many, shards=8).groupBy("source").pivot("shard").count().drop("source").toPandas()
    assert (mix.max(axis=1) - mix.min(axis=1) <= 2).all()


def test_shards_equal_sorted_rows(spark, sf_dir):
    """The law by sorting in Python: seeded hash within each source, then fractional rank over all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 11 > 0, F.col("source")))
    docs = docs.union(docs.where("doc_id % 17 = 0"))
    rows = docs.select("source", F.xxhash64(F.lit(17), F.col("doc_id")).alias("h"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["h"], r["doc_id"], zlib.crc32(r["text"].encode()), len(r["text"].encode()) + 1))
    ranked = []
    for source, members in by_source.items():
        members.sort()
        ranked += [((k + 0.5) / len(members), source is not None, source or "", k, m) for k, m in enumerate(members)]
    ranked.sort(key=lambda x: x[:4])
    want, n = [], len(ranked)
    for place, (*_, m) in enumerate(ranked):
        shard = place * 16 // n
        want.append((m[1], m[3], m[2], shard, place - -(-shard * n // 16)))
    got = [tuple(r) for r in sharding.interleave(docs).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got) == sorted(want)


# --- 4 BPE -----------------------------------------------------------------


def test_bpe(edge, nothing, vocab):
    tokenizer = pieces.load(vocab(BYTE))
    got = {r["doc_id"]: r for r in bpe.digests(edge, vocab(BYTE)).collect()}
    for d, t in texts_of(edge):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want, d
    assert bpe.digests(nothing, vocab(BYTE)).count() == 0


def test_chunks_are_shared_and_exact(vocab):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    passage = " ".join(words[:2000])
    texts = [passage, "x " + passage, " ".join(words[2000:]) + " " + passage, "中文测试" * 900, "a" * 9000, "<|endoftext|>" * 500, "\n" * 3000, "it's " * 900]
    reuse, tokenizer = bpe.Reuse(vocab(BYTE)), pieces.load(vocab(BYTE))
    for batch in (texts, texts[::-1], *[[t] for t in texts]):
        ids, at = reuse(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]
    data, at = bpe.text_bytes(pa.array(texts[:3]))
    bounds, counts = bpe.cuts(data, at)
    chunk = [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    first, second = set(chunk[: counts[0]]), set(chunk[counts[0] : counts[0] + counts[1]])
    assert len(first & second) >= 0.7 * len(first)


# --- 5 languages -----------------------------------------------------------


def test_language(spark, edge, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert [bool(zlib.crc32(str(d).encode()) % 3 == 1) for d in got.doc_id] == got.held_out.tolist()
    out = {r["doc_id"]: r for r in langid.identify(edge).collect()}
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (0, 1, 2)) and out[3]["lang_pred"] != "und"
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    rows = langid.with_languages(edge)
    assert rows.select("row.*").columns == edge.columns and rows.count() == edge.count()


def brute_language(text, table, temper, window=langid.WINDOW):
    """Shares of the best set of languages, by plain expectation-maximisation of one text over every set of the largest shares."""
    from noticeflow.llm.grams import hashed, padded

    data, _ = padded(pa.array([text]), True)
    score = table[hashed(data)].astype(float) * temper
    ll = np.array([score[k : k + window].sum(0) for k in range(0, max(len(score), 1), window)])

    def run(allowed):
        share = np.where(allowed, 1 / allowed.sum(), 0.0)
        lik = np.exp(ll - ll[:, allowed].max(1, keepdims=True)) * allowed
        for _ in range(2000):
            part = lik * share
            share = (part / part.sum(1, keepdims=True)).mean(0)
        return share, (np.log((lik * share).sum(1)) + ll[:, allowed].max(1)).sum()

    n = table.shape[1]
    order = np.argsort(-run(np.ones(n, bool))[0], kind="stable")
    sets = [np.isin(np.arange(n), order[: k + 1]) for k in range(n)]
    value = [run(a)[1] - langid.PENALTY * a.sum() * np.log(len(ll) + 1) for a in sets]
    return run(sets[int(np.argmax(value))])[0]


def test_language_against_brute_force():
    rng = np.random.default_rng(2)
    languages = 7
    table = np.log(rng.dirichlet(np.full(65536, 0.02), languages) + 1e-7).T.astype(np.float32)
    letters = np.array(list("abcdefgh"))
    texts = ["".join(rng.choice(letters, int(rng.integers(4, 2500)))) for _ in range(40)]
    lang, share = langid.infer(pa.array(texts), table)
    for t, k, s in zip(texts, lang, share, strict=True):
        want = brute_language(t, table, langid.TEMPER)
        assert want[k] >= want.max() - 0.01 and abs(s - want[k]) < 0.01
    # a text's result doesn't depend on its neighbours
    for i in (3, 17):
        one, only = langid.infer(pa.array([texts[i]]), table)
        assert one[0] == lang[i] and only[0] == share[i]


def test_mixture():
    table = np.full((65536, 2), -10.0, np.float32)
    from noticeflow.llm.grams import hashed, padded

    for k, t in enumerate(("aaaa bbbb ", "xxxx yyyy ")):
        table[hashed(padded(pa.array([t * 50]), True)[0]), k] = -2
    lang, share = langid.infer(pa.array(["aaaa bbbb " * 30 + "xxxx yyyy " * 10, "xxxx yyyy " * 40, "aaaa"]), table)
    assert lang.tolist() == [0, 1, 0] and 0.65 < share[0] < 0.85 and share[1] == 1


# --- 6 WARC ----------------------------------------------------------------


def test_warc(spark):
    html = ["<p>é</p>", "<p>é</p>", None, "", "other", "<p>é</p>", "big " * 5000]
    urls = ["http://www.B.example.com/x?q=1#f", "http://a.example.com/", None, "http://[bad", "http://a.example.com/", "no host", "https://user@c.org:8443/päth ü"]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(4, urls[4], html[4]), (None, "x", "y")], "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archived(df).collect()
    assert len(got) == 8
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for r in got:
        body = (html[r["page_id"]] or "").encode()
        to = first[body.decode()]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == r["page_id"] else ("revisit", to))
    assert warc.archived(df.where("page_id > 99")).count() == 0


def test_repeated_ids_keep_their_payloads(spark):
    rows = [(1, "u", "A"), (2, "u", "A"), (2, "u", "B"), (2, "v", "C" * 9000), (3, "u", "B"), (3, "u", "B"), (4, None, None), (4, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = {}
    for i, _, t in rows:
        least[t or ""] = min(i, least.get(t or "", i))
    want = Counter((i, len(t or ""), sha(t), *(("response", None) if least[t or ""] == i else ("revisit", least[t or ""]))) for i, _, t in rows)
    for archive in (warc.ARCHIVE, 100):  # a payload larger than an archive
        got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(df, archive=archive).collect())
        assert got == want


def test_range_reads_take_only_their_bytes(spark, monkeypatch):
    df = spark.range(40).selectExpr("id as page_id", "concat('http://h.org/', id) as url", "repeat(concat('p', id), 50) as html").coalesce(1)
    folder, captures = warc.write(df, archive=1000)
    assert captures.select("archive").distinct().count() > 3
    found = warc.Index(captures, lines=7).find(df.where("page_id in (3, 17)"))
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(folder, found, payloads=True).collect()}
    assert got == {k: f"p{k}".encode() * 50 for k in (3, 17)}


def test_revisit_without_response_fails(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    folder, captures = warc.write(df)
    assert warc.read(folder, captures).where("record_type = 'revisit'").count() == 1
    assert warc.parsed(warc.record(2, "u", b"x", 1, "u"))[0]["WARC-Refers-To"] == "<urn:page:1>"


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "v", "abcd")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.archived(df, least_revisit=3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_index_blocks(spark):
    df = spark.range(500).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id div 2) as url", "concat('p', id) as html")
    folder, captures = warc.write(df)
    index = warc.Index(captures, lines=40)
    assert len(index.directory) >= 500 // 40
    found = index.find(df.where("page_id % 3 = 0")).toPandas()
    assert sorted(found.page_id) == list(range(0, 500, 3))
    assert index.find(spark.createDataFrame([(1, "http://nowhere.org/")], "page_id long, url string")).count() == 0
    files, top = filesystem(folder)
    for r in found.itertuples():
        with files.open_input_file(f"{top}/{r.archive}") as file:
            assert warc.parsed(file.read_at(r.length, r.offset))[1] == f"p{r.page_id}".encode()


def test_url_key():
    assert warc.url_key("http://WWW.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("https://example.com:8080") == "com,example:8080)/" and warc.url_key(None) == "-"


# --- 7 TIFF ----------------------------------------------------------------


def test_tiff_round_trip(edge, nothing):
    got = {r["doc_id"]: r for r in tiff.text_features(edge).collect()}
    for d, t in texts_of(edge):
        text = (t or "").encode()
        payload = text + bytes((-len(text)) % 64 if text else 64)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [got[d] for d in (4, 50, 51)]
    assert len({(r["media_sha256"], r["media_bytes"], r["feature"]) for r in same}) == 1
    assert tiff.text_features(nothing).count() == 0


def pack_bits(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100)) if len(set(data)) > 1 or len(data) == 1 else b"".join(bytes([257 - len(data[k : k + 128]), data[0]]) for k in range(0, len(data), 128))


def lzw(data):
    codes, table, width, out, w = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, 0, b""
    n = 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = n
        n += 1
        if n + 1 > 1 << width and width < 12:
            width += 1
        if n >= 4094:
            codes.append((256, width))
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        w = bytes([b])
    if w:
        codes.append((table[w], width))
        if n + 2 > 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    bits = 0
    for c, k in codes:
        out, bits = (out << k) | c, bits + k
    return (out << (-bits % 8)).to_bytes((bits + 7) // 8, "big")


@pytest.mark.parametrize("size", [1, 2, 300, 5000, 70_000])
@pytest.mark.parametrize("letters", [2, 7, 256])
def test_encoders_return(size, letters):
    data = bytes(np.random.default_rng(size).integers(0, letters, size).astype(np.uint8))
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        assert tiff.unpacked(tiff.packed(data, compression), compression, size) == data
    if size < 10_000:
        assert tiff.to_lzw(data) == lzw(data)


def test_every_form_holds_a_text():
    texts = [("line %d of a text that is stored, " % k * (1 + k * k // 3)).encode() for k in range(60)] + [b"", b"\0" * 300, bytes(range(256)) * 20]
    used = {zlib.crc32(t) % len(tiff.FORMS) for t in texts}
    assert used == set(range(len(tiff.FORMS)))
    for t in texts:
        assert b"".join(p for *_, p in tiff.pages(tiff.text_media(t))) == t + bytes(-len(t) % 64 if t else 64)


def broken_files():
    """Files with one fault each: no width, width 0, rows per strip 0, an LZW code out of range, planes, cut off."""
    body = tiff.written([np.zeros((40, 64), np.uint8)], compression=tiff.LZW, strip_rows=10)

    def with_tag(tag, new, value):
        at = struct.unpack_from("<I", body, 4)[0]
        out = bytearray(body)
        for k in range(struct.unpack_from("<H", body, at)[0]):
            where = at + 2 + 12 * k
            if struct.unpack_from("<H", body, where)[0] == tag:
                struct.pack_into("<H", out, where, new)
                struct.pack_into("<I", out, where + 8, value)
        return bytes(out)

    bad_code = bytearray(body)
    bad_code[8:11] = (256 << 15 | 400 << 6).to_bytes(3, "big")
    return [with_tag(256, 999, 64), with_tag(256, 256, 0), with_tag(278, 278, 0), bytes(bad_code), with_tag(279, 999, 0), with_tag(257, 257, 1 << 31), with_tag(317, 317, 3), with_tag(259, 259, 77), with_tag(273, 273, 1 << 30), body[:-30], body[:9], b"II*\0" + struct.pack("<I", 1 << 31)]


def test_broken_files_give_an_error_row(spark):
    files = broken_files()
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "id long, media binary"), ["id"]).select("id", "error").collect()
    assert sorted(r["id"] for r in rows if r["error"]) == list(range(len(files)))


@pytest.mark.parametrize("size", [1, 300, 5000])
def test_decoders(size):
    data = bytes(np.random.default_rng(size).integers(65, 70, size).astype(np.uint8))
    assert tiff.unpack_bits(pack_bits(data), size) == data and tiff.unpack_bits(pack_bits(b"a" * size), size) == b"a" * size
    assert tiff.unlzw(lzw(data), size) == data


def test_pages_tiles_and_predictor(spark):
    image = np.arange(200 * 64).reshape(200, 64).astype(np.uint8)
    body = tiff.written([image[:120], image[120:]], predictor=2, strip_rows=50)
    assert [(w, h, p) for w, h, _, p in tiff.pages(body)] == [(64, 120, image[:120].tobytes()), (64, 80, image[120:].tobytes())]
    tiles = [image[y : y + 32, x : x + 48] for y in range(0, 64, 32) for x in (0, 48)]
    tiles = [np.pad(t, ((0, 32 - t.shape[0]), (0, 48 - t.shape[1]))).tobytes() for t in tiles]
    head, data = b"MM\0*" + struct.pack(">I", 8), b""
    entries = [(256, 4, 1, 64), (257, 4, 1, 64), (258, 3, 1, 8 << 16), (259, 3, 1, 1 << 16), (277, 3, 1, 1 << 16), (322, 4, 1, 48), (323, 4, 1, 32)]
    base = 8 + 2 + 12 * 9 + 4
    offsets = [base + 32 + k * 1536 for k in range(4)]
    entries += [(324, 4, 4, base), (325, 4, 4, base + 16)]
    data = struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 8) + struct.pack(">8I", *offsets, *[1536] * 4) + b"".join(tiles)
    assert [p for *_, p in tiff.pages(head + data)] == [image[:64].tobytes()]  # the chain returns to its start and ends
    rows = tiff.read_pages(spark.createDataFrame([(1, body), (2, None), (3, b"junk"), (4, b"II*\0")], "id long, media binary"), ["id"]).select("id", "page", "height", "error").collect()
    assert sorted((r["id"], r["page"], r["height"]) for r in rows if r["error"] is None) == [(1, 0, 120), (1, 1, 80)] and sorted(r["id"] for r in rows if r["error"]) == [3, 4]


# --- 8 ids -----------------------------------------------------------------


def test_ids(edge, nothing, vocab):
    tokenizer = pieces.load(vocab(WORD))
    got = repair.stored_ids(edge, vocab(WORD)).orderBy("start").collect()
    at, seen = 0, []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.append(r["doc_id"])
    assert seen == sorted(seen) and len(got) == edge.count()
    crc = {d: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts_of(edge)}
    assert all(r["ids_crc32"] == crc[r["doc_id"]] for r in got)
    tail = {d: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1][-repair.TAIL :], "<u4").tobytes()) for d, t in texts_of(edge)}
    assert all(r["tail_crc32"] == tail[r["doc_id"]] for r in got)
    assert repair.stored_ids(nothing, vocab(WORD)).count() == 0


@pytest.mark.parametrize("first", [100, 65_530, 70_000])
def test_grammar(first):
    rng = np.random.default_rng(first)
    phrase = rng.integers(0, first, 40)
    docs = [np.concatenate([phrase[rng.integers(0, 20) :], rng.integers(0, first, 5), phrase]).astype(np.uint32) for _ in range(200)] + [np.zeros(0, np.uint32), np.zeros(500, np.uint32), np.zeros(1, np.uint32)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids = np.concatenate(docs)
    body = repair.block(np.arange(len(docs)), ids, at, first)
    b = repair.Block(body)
    back, places = b.all()
    assert (back == ids).all() and (places == at).all()
    assert len(b.symbols) < 0.5 * len(ids)
    # no pair of a document's symbols is frequent any more, runs of one symbol counted without overlaps
    left = Counter()
    for k in range(len(docs)):
        s, last = b.symbols[b.starts[k] : b.starts[k + 1]].tolist(), None
        for i, pair in enumerate(zip(s, s[1:], strict=False)):
            if pair[0] == pair[1] and last == (pair, i - 1):
                continue
            left[pair] += 1
            last = (pair, i)
    assert max(left.values()) < repair.LEAST
    for k, d in enumerate(docs[:50] + docs[-3:]):
        k = k if k < 50 else len(docs) - 53 + k
        assert (b.range(k) == d).all() and (b.range(k, 7, 19) == d[7:19]).all()


# --- 9 quality -------------------------------------------------------------

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, edge, nothing, sf_dir):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (4, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").withColumn("id", F.lit("clash"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.rules(edge, labels.drop("id")).collect():
        text = dict(texts_of(edge))[r["doc_id"]]
        assert tuple(r[n] for n in names) == brute(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality.rules(nothing, labels.drop("id")).count() == 0
    nobody = quality.rules(edge, labels.drop("id").where("doc_id < 0")).collect()
    assert all(r["kept"] != r["base_failed"] for r in nobody)
    docs, known = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.rules(docs, known).join(known, "doc_id").where("not base_failed").toPandas()
    assert (got.kept[got.quality == 1]).mean() > 0.95


def brute_rules(texts, labels, folds):
    """kept of each text by counting n-grams in dictionaries, with each fold's rows left out of the ratio that scores them."""
    grams = [[hash_of(b" " + (t or "").encode() + b"  ", k) for k in range(len((t or "").encode()))] for t in texts]
    corpus = Counter(g for one in grams for g in one)

    def ratio(rows):
        trusted = Counter(g for i in rows for g in grams[i])
        nt, nc = (sum(c.values()) + quality.SMOOTH * 65536 for c in (trusted, corpus))
        return lambda g: np.log((trusted[g] + quality.SMOOTH) / nt) - np.log((corpus[g] + quality.SMOOTH) / nc)

    score = lambda i, r: sum(map(r, grams[i])) / max(len(grams[i]), 1)
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in map(brute, texts)]
    good = [i for i, q in labels.items() if q == 1]
    seen = [(q, score(i, ratio([g for g in good if folds[g] != folds[i]]))) for i, q in labels.items() if not failed[i]]
    values = sorted({v for _, v in seen})
    cuts = [-np.inf] + [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    share = lambda q, hit: np.mean([hit(v) for k, v in seen if k == q])
    cut = min(cuts, key=lambda c: (round(quality.GOOD * share(1, lambda v: v < c) + share(0, lambda v: v >= c), 9), c))
    whole = ratio(good)
    return [not f and score(i, whole) >= cut for i, f in enumerate(failed)]


def hash_of(data, k):
    code = int.from_bytes(data[k : k + 4], "little")
    return (code * 2654435761 & 0xFFFFFFFF) >> 16


def test_quality_verdict_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [[f"{a}{k}" for k in range(300)] for a in ("fine", "spam")]
    texts = [" ".join(rng.choice(words[int(i % 3 == 0)] if rng.random() < 0.8 else words[1 - int(i % 3 == 0)], int(rng.integers(40, 160)))) for i in range(90)] + [None, "", "é" * 400]
    texts[5] = texts[4]
    known = {i: int(i % 3 != 0) for i in range(0, 60)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fold", F.lit("clash")).withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    folds = {r["id"]: r["f"] for r in spark.range(60).selectExpr("id", f"pmod(xxhash64(id), {quality.FOLDS}) as f").collect()}
    got = {r["doc_id"]: r["kept"] for r in quality.rules(docs, labels).collect()}
    assert [got[i] for i in range(len(texts))] == brute_rules(texts, known, folds)


def test_threshold():
    assert quality.threshold(np.array([1, 1, 0, 0]), np.array([3.0, 2.0, 1.0, 0.0])) == 1.5
    assert quality.threshold(np.array([1, 1]), np.array([3.0, 2.0])) == -np.inf


# --- 10 near duplicates ----------------------------------------------------


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = rng.choice(words, 150).tolist()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(w))
    return texts


def brute_shingles(text):
    """Runs of five words of a text, by plain string operations, and how often each occurs."""
    words = [w for w in re.split(r"[\x00-\x2f:-@\[-`{-\x7f]+", text.lower()) if w]
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))


def brute_similarity(texts):
    """Weighted Jaccard similarity of all pairs of different texts, by dictionaries."""
    terms = [brute_shingles(t) for t in texts]
    sh, _, at = neardup.shingles(pa.array(texts))
    sketch = neardup.sketches(sh, at).T.tolist()
    alike = [Counter(column) for column in sketch]
    counts = iter(1 / max(a[x] for a, x in zip(alike, row, strict=True)) for row in zip(*sketch, strict=True))
    part = [next(counts) if t else 0 for t in terms]
    n = sum(part)
    df = Counter()
    for t, p in zip(terms, part, strict=True):
        for g in t:
            df[g] += p
    rare = lambda d: min(1, np.log1p(n / max(1, d)) / np.log1p(max(1, n)))
    weight = [{g: (1 + np.log(k)) * (neardup.FLOOR + (1 - neardup.FLOOR) * rare(df[g])) for g, k in t.items()} for t in terms]
    total = [sum(w.values()) for w in weight]
    for i, a in enumerate(weight):
        for j in range(i):
            both = sum(min(w, weight[j][g]) for g, w in a.items() if g in weight[j])
            if both:
                yield j, i, both / (total[i] + total[j] - both)


def brute_classes(texts):
    """The smallest place of each text's class; equal texts are one."""
    different = list(dict.fromkeys(texts))
    parent = {t: t for t in different}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, j, s in brute_similarity(different):
        if s >= neardup.LEAST:
            parent[root(different[i])] = root(different[j])
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(root(t), k)
    return [first[root(t)] for t in texts]


@pytest.mark.parametrize("members", [256, 4])
def test_near_duplicates(spark, members, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    texts = corpus() + ["Short one", "short, ONE", "the shared passage of a license that many documents hold " * 3]
    texts += [f"{t} the shared passage of a license that many documents hold" for t in texts[:30]]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_of_documents(spark, sf_dir):
    """Every pair of the given documents that is similar enough shares a class, and every class is such pairs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is not None]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    want = brute_classes([t for _, t in rows])
    names = {k: min(rows[i][0] for i, w in enumerate(want) if w == k) for k in set(want)}
    assert [got[d] for d, _ in rows] == [names[w] for w in want]


@pytest.mark.parametrize("members", [8, 2])
def test_strays_meet_a_large_component(spark, members, monkeypatch):
    """Blocks give the links between a large component and others, and among the others, whatever their numbers."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 60))] = f"x{rng.integers(0, 99)}"
        rows.append((i, " ".join(words)))
    sh, tf, at = neardup.shingles(pa.array([t for _, t in rows]))
    factor = np.ones(neardup.CELLS, np.float32)
    part = lambda i: (sh[at[i] : at[i + 1]], tf[at[i] : at[i + 1]].astype(np.float32))
    component = [0 if i < 30 else i // 3 for i in range(40)]
    table = spark.createDataFrame([(i, [7] * neardup.BANDS, sh[at[i] : at[i + 1]].tobytes(), b"") for i in range(40)], "id long, keys array<long>, sh binary, tf binary")
    rest = spark.createDataFrame([(7, i, 40, 0, 1, 2, c) for i, c in enumerate(component)], "key long, id long, n long, l0 long, l1 long, l2 long, component long")
    got = {(r["a"], r["b"]) for r in neardup._in_blocks(rest, table, factor, 0.7).collect()}
    want = {(i, j) for j in range(3, 40) for i in range(3, j) if component[i] != component[j] and neardup.similarity(*part(i), *part(j), factor) >= 0.7}
    assert got == want and want


def test_near_duplicate_edges(spark, edge, nothing):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(edge).collect()}
    assert got[4] == got[50] == got[51] == 4 and all(got[d] == d for d in (0, 1, 2, 3, 5, 6, 7, 8, 9))
    assert neardup.classes(edge).count() == edge.count() and neardup.classes(nothing).count() == 0
    # an id with two texts: each row goes with its text
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "pqr"]
    both = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1] + " end"), (4, texts[2]), (4, texts[2])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in neardup.classes(both).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    ids = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in neardup.classes(ids).collect()) == [(-1, -1), (-1, -1), (7, 7)]


def test_sampling_follows_similarity():
    texts = corpus(5)[:40]
    sh, tf, at = neardup.shingles(pa.array(texts))
    ones = np.ones(neardup.CELLS, np.float32)
    got = neardup.Sampler(400)(sh, neardup.weights(sh, tf.astype(np.float32), ones), at[:-1], np.diff(at))
    for i, j in ((0, 1), (1, 2), (0, 20)):
        part = lambda k: (sh[at[k] : at[k + 1]], tf[at[k] : at[k + 1]].astype(np.float32))
        assert abs((got[:, i] == got[:, j]).mean() - neardup.similarity(*part(i), *part(j), ones)) < 0.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 101, 102, 103), 100)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
