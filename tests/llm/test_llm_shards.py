"""Sharding, source audit and prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guichet.llm import prefix_trie, sharding, source_audit
from guichet.operators.settle import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- op11


def sharded(spark, df, **options):
    return sharding.write_shards(df, shared_folder(spark), **options)


def placed(df):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "shard", "slot")) for r in df.collect()), key=repr)


def check_law(rows, shards):
    slots = defaultdict(list)
    for *_, shard, slot in rows:
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_shards_hold_every_row_once(spark, docs):
    out = sharded(spark, docs, bucket_bytes=1 << 14)
    assert sorted(out.columns) == sorted([*docs.columns, "shard", "slot"])
    check_law(placed(out), 16)
    assert sorted(map(repr, out.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_shards_do_not_depend_on_partitions(spark, docs):
    first = placed(sharded(spark, docs, bucket_bytes=1 << 16))
    assert placed(sharded(spark, docs.repartition(7, "n_chars"), bucket_bytes=1 << 16)) == first
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert placed(sharded(spark, docs, bucket_bytes=1 << 16)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert placed(sharded(spark, docs, bucket_bytes=1 << 16, seed=1)) != first


def test_shards_spread_copies_of_a_row(spark, docs):
    copies = docs.limit(1).join(spark.range(3000).select(F.lit(1).alias("_")), F.lit(True)).drop("_").unionByName(docs)
    one = docs.first()
    rows = placed(sharded(spark, copies, bucket_bytes=1 << 14))
    check_law(rows, 16)
    assert Counter(r[:2] for r in rows) == Counter({**{(r.doc_id, r.text): 1 for r in docs.collect()}, (one.doc_id, one.text): 3001})
    per_shard = Counter(r[2] for r in rows if r[0] == one.doc_id)
    assert all(140 < per_shard[s] <= 201 for s in range(16))
    assert placed(sharded(spark, copies.repartition(5), bucket_bytes=1 << 14)) == rows


def test_order_is_shuffled(spark):
    n = 4000
    rows = sharded(spark, spark.range(n).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")), bucket_bytes=1 << 11, shards=1)
    order = [r.doc_id for r in rows.orderBy("slot").collect()]
    assert sorted(order) == list(range(n))
    ups = sum(a < b for a, b in zip(order, order[1:]))
    assert abs(ups - n / 2) < 150  # five deviations
    assert sum(a == i for i, a in enumerate(order)) < 10
    # Halves of the order hold halves of the ids.
    assert abs(sum(a < n / 2 for a in order[: n // 2]) - n / 4) < 160


def test_files_hold_the_order(spark, docs):
    folder = shared_folder(spark)
    want = {(r.shard, r.slot): r.doc_id for r in sharding.write_shards(docs, folder, bucket_bytes=1 << 15, shards=3).collect()}
    for shard in range(3):
        files = sorted(r[0] for r in spark.read.parquet(f"{folder}/shard={shard}").select(F.input_file_name()).distinct().collect())
        got = [r.doc_id for f in files for r in spark.read.parquet(f).collect()]
        assert got == [want[shard, i] for i in range(len(got))]


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 300_000, None, "s", 1), (3, "é", "fr", None, 2)]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("mine")).withColumn("bucket", F.lit(1)).withColumn("key", F.lit("k")).withColumn("row", F.lit(2))
    out = sharded(spark, df, bucket_bytes=1 << 12)
    assert dict(out.dtypes)["shard"] == "int" and {"bucket", "key", "row"} <= set(out.columns)
    got = out.collect()
    check_law([(r.doc_id, r.text, r.shard, r.slot) for r in got], 16)
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id) == sorted((False, r[0], r[1]) for r in rows if r[0])
    empty = sharded(spark, df.limit(0))
    assert empty.count() == 0 and set(empty.columns) == {*df.columns, "slot"}


# --- op12

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: c for (l, s), c in groups.items() if l == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in source_audit.audit_sources(df, **options).collect())


def test_audit_equals_brute_force(spark, docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(docs, min_docs=5, top=7) == brute_audit(rows, 5, 7)


@pytest.mark.parametrize("distributed", [False, True])
def test_audit_in_small_tiles_and_pieces(spark, docs, monkeypatch, distributed):
    from guichet.operators import settle

    monkeypatch.setattr(source_audit, "TILE", 3)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 40)
    if distributed:
        monkeypatch.setattr(settle, "BROADCAST_ROWS", 0)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert audited(docs, min_docs=5) == brute_audit(rows, 5, 50)


def test_terms_of_long_texts(monkeypatch):
    texts = ["", "A b\x00c'd é-É ", "Ω" * 50 + "1" + "x" * 70 + " end", "aB" * 500, "ab " * 300]
    for piece in (1 << 20, 16, 1):
        monkeypatch.setattr(source_audit, "PIECE_BYTES", piece)
        for text in texts:
            assert source_audit.term_counts(text.encode()) == Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))


def test_audit_of_odd_rows(spark):
    rows = [
        (1, None, None, None, 0), (2, "one two", None, "", 0), (3, "", "en", "a", 0), (4, "123", "en", "b", 0), (5, "ÀB c d", "fr", "x", 0),
        (5, "ÀB c d", "fr", "x", 0), (6, "c c c zz", "fr", "y", 0), (7, "z" * 200_000, "fr", None, 0), (8, "c", "it", "only", 0),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("number", F.lit("n")).withColumn("term", F.lit(0)).withColumn("p", F.lit(None))
    plain = [(r[2], r[3], r[1]) for r in rows]
    for least in (1, 2, 30):
        assert audited(df, min_docs=least) == [tuple(r) for r in brute_audit(plain, least, 50)]
    assert audited(df.limit(0)) == []


def test_audit_counts_beyond_64_bits(spark):
    df = spark.sql("select 9000000000000000000L as n, 9000000000000000000L as total, 100L as terms")
    got = df.select(source_audit._share("n", "total", "terms")).first()[0]
    assert got == 1 + 1_000_000_000 * (9 * 10**18 + 5) // (9 * 10**18 + 500)


# --- op13

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")


def test_trie_equals_brute_force(turns):
    assert trie(turns) == brute_trie([tuple(r) for r in turns.collect()])


def many_turns():
    """Long conversations, copies, bases that are absent or short, and negative ids."""
    rows = []
    for c in [*range(-7, 40), 10**12, 10**12 + 3]:
        if c in (10, 25):
            continue
        for t in range(1 + (c * 7) % 13 if c % 6 else 45):
            rows.append((c, t, "user" if t % 2 else None, f"turn {t} {c % 3 if t > 4 else ''}" if t != 3 else None))
    return rows


@pytest.mark.parametrize("shard, segment", [(512, 512), (4, 3), (1, 1), (7, 64)])
def test_trie_in_small_shards(spark, monkeypatch, shard, segment):
    from guichet.operators import settle

    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    if shard == 4:
        monkeypatch.setattr(settle, "BROADCAST_ROWS", 0)
    rows = many_turns()
    assert trie(spark.createDataFrame(rows, TURNS).repartition(3)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, "a", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "b", "tie"), (1, 5, "", "x" * 200_000), (None, 1, "a", "lost"),
        (5, 2, "u", "é"), (5, 1, "u", "É"), (6, None, None, None), (7, 1, "u", "É"), (8, 1, "u\x00", "É"), (9, 1, "u", "\x00É"),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("p")).withColumn("high", F.lit(1)).withColumn("shard", F.lit(None))
    assert trie(df) == brute_trie(rows)
    assert trie(df.limit(0)) == []
    renamed = df.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    assert len(prefix_trie.prefix_trie(renamed, "c", "t", "r", "x").collect()) == len(brute_trie(rows))
