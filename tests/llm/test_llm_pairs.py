"""Near duplicates, vector search, url rules and WARC archives against brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from guichet.llm import graph_search, minhash_join, url_rules, warc
from guichet.llm.common import table
from guichet.llm.components import components
from guichet.session import shared_folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op9


def shingles(text):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_components(rows):
    """Per row its set size and component, rows as nodes."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverse = defaultdict(list)
    for i, own in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for s in own for j in inverse[s]).items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for s in own:
            inverse[s].append(i)
    lowest = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            lowest[find(i)] = min(lowest.get(find(i), name), name)
    out = []
    for i, (name, _) in enumerate(rows):
        component = None if name is None else lowest[find(i)]
        out.append((name, len(sets[i]), component, name == component))
    return sorted(out, key=repr)


def near_copies(seed, n, base_words=120, edits=3):
    pick = random.Random(seed)
    base = [f"w{pick.randrange(500)}" for _ in range(base_words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(edits):
            own[pick.randrange(base_words)] = f"e{pick.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def odd_rows(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE two"), (9004, "one two three"), (None, rows[0][1])]
    rows += [(None, None), rows[3], (9005, rows[5][1]), (-4, rows[5][1]), (rows[6][0], rows[7][1])]
    rows += [(9100 + i, t) for i, t in enumerate(near_copies(1, 60))] + [(9300 + i, t) for i, t in enumerate(near_copies(2, 40, 60, 2))]
    # A chain: each text is near the next, the ends are far apart.
    words = [f"c{i}" for i in range(160)]
    rows += [(9500 + k, " ".join(words[4 * k : 4 * k + 80])) for k in range(20)]
    return rows


@pytest.mark.parametrize("distributed", [False, True])
def test_near_duplicates(spark, odd_rows, distributed, request, monkeypatch):
    if distributed:
        request.getfixturevalue("small_broadcasts")
        monkeypatch.setattr(minhash_join, "BLOCK", 8)
        monkeypatch.setattr(minhash_join, "PARTNERS", 4)
    docs = spark.createDataFrame([(*r, 1) for r in odd_rows], "doc_id long, text string, n_shingles int")
    got = sorted(map(tuple, minhash_join.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(odd_rows)


def test_keep_one_of_each(spark, odd_rows):
    docs = spark.createDataFrame([(*r, 1) for r in odd_rows], "doc_id long, text string, kept int")
    kept = minhash_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    # A row that is there twice stays once, rows without an id stay.
    want = Counter()
    for name, _, component, stays in brute_components(odd_rows):
        if name is not None and stays:
            want[name] += 1
    named = Counter()
    for (name, _), n in got.items():
        if name is not None:
            assert n == 1
            named[name] += 1
    assert set(named) == set(want)
    assert sum(n for (name, _), n in got.items() if name is None) == 2


def test_keep_one_of_each_where_ids_have_several_texts(spark):
    def text(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    z, x, w = text("z"), text("x"), text("w")
    rows = [
        (5, z, "a"), (6, x, "a"), (6, z + " more", "a"),  # x is alone, the other copies 5
        (7, x + " end", "a"), (8, w, "a"), (8, w + " end", "a"), (8, w, "b"), (8, w, "b"),  # one of 8 stays
        (9, "", "a"), (9, None, "a"), (9, "", "a"), (9, text("v"), "a"), (10, text("v") + " end", "a"), (None, z, "a"),
    ]
    kept = minhash_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert got == sorted([(5, z, "a"), (6, x, "a"), (8, w, "a"), (9, "", "a"), (9, None, "a"), (9, text("v"), "a"), (None, z, "a")], key=repr)


def test_near_duplicates_with_names_for_ids(spark):
    copies = near_copies(3, 5, edits=1)
    rows = [("b", copies[0]), ("a", copies[1]), ("10", copies[2]), ("9", "another text of a few words"), (None, copies[3]), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash_join.near_duplicates(docs).collect()}
    first = {name: ("10", name == "10") for name in ("a", "b", "10")}
    assert got == {**first, "9": ("9", True), "c": ("c", True), None: (None, True)}
    assert sorted(r["doc_id"] or "" for r in minhash_join.keep_one_of_each(docs).collect()) == ["", "10", "9", "c"]


def test_pairs_at_the_threshold_are_lost_less_often_than_keys_lose_them():
    def beyond(n, most, p):
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))

    differ = 1 - minhash_join.PERCENT / 100
    no_key = beyond(minhash_join.CHUNK, 1, differ) ** minhash_join.CHUNKS
    assert beyond(minhash_join.SYMBOLS + minhash_join.FINE, minhash_join.MOST_ERRORS, differ) < no_key / 5
    n = minhash_join.SKETCH
    least = math.ceil(n * (1 - differ) - minhash_join.DEVIATIONS * (n * differ * (1 - differ)) ** 0.5)
    assert beyond(n, n - least, differ) < no_key / 5


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_join.near_duplicates(docs).collect() == []
    assert minhash_join.keep_one_of_each(docs).collect() == []


def test_signatures_within_the_guaranteed_distance_share_a_key():
    pick = np.random.default_rng(3)
    for _ in range(300):
        a = pick.integers(0, 1 << 16, minhash_join.SYMBOLS).astype(np.uint16)
        b = a.copy()
        errors = pick.choice(minhash_join.SYMBOLS, minhash_join.GUARANTEED, replace=False)
        b[errors] ^= 1
        keys = minhash_join.keys_of(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (500, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- op7


def brute_nearest(rows, k, every):
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and (v != 0).any()]
    usable = list({(i, tuple(v)): (i, v) for i, v in usable}.values())
    out = {}
    for i, v in usable:
        if i % every == 0:
            scores = sorted((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in usable if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def found_nearest(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    """Share of the best scores that were found."""
    hits = total = 0
    for query, best in want.items():
        worst = best[-1][1] if best else 0
        hits += sum(score >= worst - 1e-9 for _, score in got.get(query, [])[: len(best)])
        total += len(best)
    return hits / total


def test_search(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    common = rows[2][1]
    rows += [(10_000 + i, common) for i in range(120)]  # a very common vector
    rows += [(20_000, None), (20_020, [0.0] * 64), (20_040, [float("nan")] * 64), (20_060, [None] * 64), (None, rows[1][1]), rows[20]]
    rows += [(30_000, [1.0, 2.0]), (30_001, [3.0, 2.0]), (30_002, [2.0, -1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    want = brute_nearest(rows, 20, 20)
    got = found_nearest(graph_search.nearest_neighbours(df, shard_rows=150))
    assert set(got) == set(q for q, best in want.items() if best)
    assert recall(got, want) >= 0.95
    assert all(len(got[q]) == len(best) for q, best in want.items())
    # The copies of the common vector come in the order of their ids.
    assert [j for j, _ in got[10_000]] == [j for j, _ in want[10_000]]
    assert got[30_000] == [(30_001, 7.0), (30_002, 0.0)]
    exact = {q: dict(best) for q, best in want.items()}
    assert all(abs(s - exact[q][j]) < 1e-12 for q, best in got.items() for j, s in best if j in exact[q])
    assert graph_search.nearest_neighbours(df.limit(0)).collect() == []
    assert graph_search.nearest_neighbours(df.where("vec_id = 20")).collect() == []


def test_search_by_inner_product(spark):
    """Vectors of very different norms: the nearest are not those of the smallest angle."""
    pick = np.random.default_rng(4)
    points = pick.normal(size=(1500, 16)) * pick.lognormal(0, 0.7, (1500, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(found_nearest(graph_search.nearest_neighbours(df, shard_rows=800)), brute_nearest(rows, 20, 20)) >= 0.9


def test_search_of_dense_groups(spark):
    """A third of the rows in one small region."""
    pick = np.random.default_rng(6)
    points = np.concatenate([pick.normal(size=(1400, 32)), pick.normal(size=(1, 32)) + 0.05 * pick.normal(size=(700, 32))])
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(pick.permutation(points))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(found_nearest(graph_search.nearest_neighbours(df)), brute_nearest(rows, 20, 20)) >= 0.9


# --- op4

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "deep.host.org", "/fr/a/b/file"), ("allow", "same.org", "/x"), ("block", "same.org", "/x"), ("block", "Upper.COM", "/"),
]
URLS = [
    None, "", "no scheme.net/", "http://a.net", "http://a.net/", "http://net/x", "https://A.Example.NET/en/1?q=/fr/", "http://example.net/en",
    "http://notexample.net/en/x", "http://xexample.com/de/1", "http://example.com/de/1#/x", "http://a.b.c.example.com/de/", "ftp://org/fr/",
    "http://deep.host.org/fr/a/b/file.html", "http://x.deep.host.org/fr/a/b/", "http://same.org/xyz", "http://a.net?x=/", "http://a..net/",
    "http://net./", "x://y://z.net/en", "http://a.net:80/", "http://\n.net/\n", "http://upper.com/", "http://org/fr/" + "a/" * 500,
    "http://" + "a." * 500 + "net/", "http://ünï.net/ö", "://net/",
]


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = re.search(r"[/?#]", rest)
        host = (rest[: end.start()] if end else rest).translate(LOWER)
        path = re.split(r"[?#]", rest[end.start() :] if end else "")[0]
    fits = []
    for verdict, own, start in rules:
        own = own.translate(LOWER)
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            fits.append((len(own + start), len(own), verdict == "block", own + start, verdict))
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


@pytest.mark.parametrize("distributed", [False, True])
def test_url_rules(spark, distributed, request):
    if distributed:
        request.getfixturevalue("small_broadcasts")
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], "clash"), (3, URLS[3], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES + [(None, "a", "/"), ("block", None, "/")], "verdict string, host string, path string")
    got = Counter(map(tuple, url_rules.judge_urls(pages, rules).collect()))
    assert got == Counter((i, *brute_verdict(u, RULES)) for i, u, _ in rows)
    none = url_rules.judge_urls(pages, rules.limit(0), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "block")} and len(none) == len(rows)
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []


def test_url_rules_stay_in_the_jvm(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    plan = url_rules.judge_urls(table(spark, SF, "pages"), rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op8


def brute_records(rows, least):
    first = {}
    for i, html in rows:
        if i is not None:
            data = (html or "").encode()
            first[data] = min(first.get(data, i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        origin = first.get(data) if len(data) >= least else None
        revisit = origin is not None and i != origin
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", origin if revisit else None))
    return sorted(out, key=repr)


TRAP = "<p>WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nabc\r\n\r\nWARC/1.0\r\n</p>"


@pytest.mark.parametrize("split_bytes", ["128m", "700"])
def test_archive_round_trip(spark, split_bytes):
    rows = [(i, f"http://x/{i}\r\ny", TRAP + str(i) * (i % 50) if i % 3 == 0 else ("é" * i if i % 5 else "")) for i in range(150)]
    rows += [(7, "u", "é" * 7), (None, None, None), (None, "u", "only without id"), (401, None, "WARC/1.0\r\n" * 30), (-3, "u", "é" * 8)]
    rows += [(402, "u", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    old = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for least in (0, 60):
            got = sorted(map(tuple, warc.archive_round_trip(pages, least).collect()), key=repr)
            assert got == brute_records([(i, h) for i, _, h in rows], least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_archive_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).collect() == []


def test_damaged_archive(spark, tmp_path):
    """Records before the damage are read, what cannot be reached is not."""
    folder = str(tmp_path / "archive")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 5) for i in range(6)], "page_id long, url string, html string")
    warc.write_archive(pages.coalesce(1).orderBy("page_id").coalesce(1), folder)
    (file,) = (tmp_path / "archive").glob("part-*")
    data = file.read_bytes()
    at = data.index(b"page 3 ")
    file.write_bytes(data[:at] + data[at + 4 :])
    (tmp_path / "archive" / f".{file.name}.crc").unlink(missing_ok=True)
    got = sorted(r["page_id"] for r in warc.read_archive(spark, folder).collect())
    assert got[:3] == [0, 1, 2] and not {4, 5} & set(got)


def test_digest_in_sql_functions(spark):
    from pyspark.sql import functions as F

    data = [b"", b"a", "é".encode() * 9]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    got = [r[0] for r in df.select(warc.base32_of_hex(F.sha1("d"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(d).digest()).decode() for d in data]


def test_folder_is_shared(spark):
    assert shared_folder(spark).startswith(spark.sparkContext.getCheckpointDir())
