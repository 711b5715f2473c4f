"""Rows that go wrong easily, and results against plain forms of what an operator learns, spreads or iterates."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOC, ODD, SF, brute_hits, brute_secrets, docs, frame, words  # noqa: F401

import corpus_pipeline
from convoq import scratch
from convoq.llm import classifier, common, decontaminate, mixing, quality_rules, rans, secret_scan, simhash, suffix_dedup, url_filters, wrappers
from convoq.llm.queries import ORACLE_SQL

LABELS = "doc_id long, quality int, toxic int"
ITEMS = [(1, "a benchmark item of more than five words"), (2, None)]
PAGES = "page_id long, url string, html string"
#: Names that stages have used for columns of their own, and names of their results.
CLASHING = ("stats", "hits", "its_text", "first_id", "first_text", "source_name", "hash", "tie_source", "tie_hash", "whole", "below", "k", "row", "copies", "h", "th", "fp", "size", "kept", "n", "threshold", "a.b")


def long_text(n=2_000_000):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    out = []
    while n > 0:
        out.append(rng.choice(known))
        n -= len(out[-1]) + 1
    return " ".join(out)


LONG = long_text()
ROWS = ODD + [(77, LONG, "a"), (78, "tie " + "same words all over again and again " * 9, "b"), (79, "tie " + "same words all over again and again " * 9, "b"), (None, "no id at all", "c"), (None, "no id at all", "c")]


def wide(spark, rows):
    df = frame(spark, rows, extra=False)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"x{c}"))
    return df


def labels(spark):
    return spark.createDataFrame([(10_009, 1, 0), (10_003, 0, 0), (10_004, None, 0), (None, 1, 0), (10_003, 1, 0)], LABELS)


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


PER_DOC = {
    "op1": lambda s, d: suffix_dedup.dedup(d),
    "op3": lambda s, d: mixing.mix(d),
    "op4": lambda s, d: quality_rules.judged(d, labels(s)),
    "op5": lambda s, d: classifier.scored(d, classifier.fit(d, labels(s))),
    "op6": lambda s, d: simhash.near_duplicates(d),
    "op7": lambda s, d: secret_scan.scan(d),
    "op8": lambda s, d: rans.round_trip(d),
    "op10": lambda s, d: decontaminate.contaminated(d, bench(s)),
}
STAGES = {
    "quality_rules": lambda s, d: quality_rules.kept(d, labels(s)),
    "simhash_near_dedup": lambda s, d: simhash.keep_one(d),
    "benchmark_decontamination": lambda s, d: decontaminate.clean(d, bench(s)),
    "source_mixing": lambda s, d: mixing.mixed(d),
}


@pytest.mark.parametrize("name", sorted(PER_DOC))
def test_operators_give_each_row_a_result(spark, name):
    df = wide(spark, ROWS)
    before = dict(spark.conf.getAll)
    got = PER_DOC[name](spark, df)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(i for i, _, _ in ROWS)
    assert PER_DOC[name](spark, df.limit(0)).count() == 0
    nothing = frame(spark, [(None, None, None)] * 3, extra=False)
    assert PER_DOC[name](spark, nothing).count() == 3
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns_of_any_name(spark, name):
    df = wide(spark, ROWS)
    got = STAGES[name](spark, df)
    assert got.columns == df.columns
    rows = Counter((r.doc_id, r.text) for r in df.collect())
    kept = got.collect()
    assert kept and all((r.doc_id, r.text) in rows for r in kept)
    assert all(r[len(df.columns) - len(CLASHING) + i] == f"x{c}" for r in kept for i, c in enumerate(CLASHING))
    assert STAGES[name](spark, df.limit(0)).count() == 0
    if name != "source_mixing":
        assert not Counter((r.doc_id, r.text) for r in kept) - rows


def test_pages_with_odd_rows(spark):
    long_page = "<body><nav>menu</nav><article>" + f"<p>{LONG[:200_000]}</p>" * 10 + "</article></body>"
    rows = [(1, None, None), (None, "http://a.b/x", "<p>x"), (2, "http://a.b/x", long_page), (2, "http://a.b/x", long_page), (3, "", ""), (4, "no host", "<p>y</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("z")).withColumn("verdict", F.lit(1)).withColumn("text", F.lit("q")).withColumn("region", F.lit("r"))
    got = Counter(tuple(r) for r in wrappers.main_texts(pages).select("page_id", "n_chars").collect())
    assert got[2, len(LONG[:200_000].strip()) * 10 + 18] == 2 and sum(got.values()) == len(rows)
    assert Counter(r.page_id for r in url_filters.judge(pages).collect()) == Counter(i for i, _, _ in rows)


# Mixing rows without ids -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_mix_is_near_its_target_when_ids_tie(spark, ids, monkeypatch):
    monkeypatch.setattr(mixing, "SHARE_ROWS", 90)  # so that a tie has several shares
    of = {"null": lambda i: None, "one": lambda i: 5, "few": lambda i: i % 3}[ids]
    for texts in (lambda i: f"word {i} " * 5, lambda i: "same ten words " * 3 + "x") if ids == "null" else (lambda i: "same ten words " * 3 + "x",):
        rows = [(of(i), texts(i), "s") for i in range(800)]
        total = sum(len(words(t)) for _, t, _ in rows)
        df = wide(spark, rows)
        got = mixing.mix(df).collect()
        taken = sum(r.size * r.copies for r in got)
        assert len(got) == 800 and abs(taken - 1.5 * total) <= 10, (ids, taken, total)
        again = mixing.mix(df.repartition(7)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        mixed = mixing.mixed(df)
        assert mixed.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in mixed.collect()) == _copies(rows, got)


def _copies(rows, got):
    """(doc_id, text) as often as got takes rows of that id and size; all texts of one id and size in these tests are as likely."""
    if len({t for _, t, _ in rows}) == 1:
        out = Counter()
        for r in got:
            out[r.doc_id, rows[0][1]] += r.copies
        return out
    text = defaultdict(list)
    for i, t, _ in rows:
        text[i, zlib.crc32(t.encode())].append(t)
    spark_copies = Counter()
    plan = duckdb.sql("select 1")  # noqa: F841
    import hashlib

    for i, t, _ in rows:
        name = f"mix:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}:0"
        spark_copies[i, t] = int(hashlib.md5(name.encode()).hexdigest()[:15], 16)
    order = sorted(spark_copies, key=spark_copies.get)
    more = sum(r.copies == 2 for r in got)
    return Counter({k: 1 + (n < more) for n, k in enumerate(order)})


def test_mix_refuses_parts_of_a_copy(spark, docs):  # noqa: F811
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, docs[:3]), most=1.5)


# Token files --------------------------------------------------------------------------------------------------------


def test_rows_without_ids_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(rans, "PART_IDS", 100)
    rows = [(None if i % 3 == 0 else i, "the same text for all" if i % 2 else f"text {i} of many", "s") for i in range(3000)]
    tokens = common.written(rans.tokenized(frame(spark, rows)).withColumn("row", F.monotonically_increasing_id()), "tokens")
    _, n = rans.count_ids(tokens)
    sizes = [r["count"] for r in rans.in_parts(tokens, n).groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * 3000 / len(sizes), sizes


def test_a_table_of_many_ids_and_a_text_of_many_blocks():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(300_000), rng.integers(0, 300_000, 50_000)]).astype(np.uint32)
    table = rans.Table.of_counts(*(x.astype(np.int64) for x in np.unique(ids, return_counts=True)))
    assert table.precision == 20 and (table.freq > 0).all()
    assert (rans.decode_block(*rans.encode_block(ids, table), len(ids), table) == ids).all()
    with pytest.raises(ValueError):
        rans.Table(np.array([3, 4]))


# Decontamination -----------------------------------------------------------------------------------------------------


def test_many_blocks_are_no_chain(spark, docs, monkeypatch):  # noqa: F811
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    size = sum(len(t) for _, t in items)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size // 8)
    df = wide(spark, docs[:60] + [(9000, "lead " + items[0][1] + " tail " + items[-1][1], "x")] * 2)
    out = decontaminate.with_hits(df, spark.createDataFrame(items, "item_id long, text string"), name="found")
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 0
    expect = brute_hits([(r.doc_id, r.text, None) for r in df.select("doc_id", "text").collect()], items)
    assert Counter((r.doc_id, len(r.found)) for r in out.select("doc_id", "found").collect()) == _sum((k[0], k[2], n) for k, n in expect.items())


def _sum(rows):
    out = Counter()
    for i, k, n in rows:
        out[i, k] += n
    return out


# Link graphs ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_propagation_equals_dense_power_iteration(spark, seed):
    rng = random.Random(seed)
    n = 40
    hosts = [f"h{i}.org" for i in range(n)]
    pages, links = [], defaultdict(set)
    for p in range(160):
        i = rng.randrange(n)
        to = {rng.randrange(n) for _ in range(rng.randint(0, 4))}
        ruled = rng.random() < 0.2
        url = f"http://{'www.example.com' if ruled and i % 2 else 'x.net' if ruled else hosts[i]}/{'en' if i % 2 else 'es'}/{p}"
        html = "".join(f'<a href="//{hosts[j].upper() if rng.random() < 0.5 else hosts[j]}/q">l</a><a href="http://{hosts[j]}">l</a>' for j in to)
        pages.append((p, url, html))
        links[url.split("/")[2]] |= set()
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: r for r in url_filters.judge(df).collect()}
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    for p, verdict, t, d in c.sql(ORACLE_SQL["op2_url_filters"]).select("page_id, verdict, host_trust, host_distrust").fetchall():
        assert got[p].verdict == verdict and got[p].host_trust == pytest.approx(t) and got[p].host_distrust == pytest.approx(d)
    names = sorted({url_filters_host(u) for _, u, _ in pages} | set(hosts))
    at = {h: k for k, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for _, u, html in pages:
        for dst in {x.lower() for x in re.findall(r'href="(?:http:)?//([^/"]+)', html)}:
            if dst != url_filters_host(u):
                m[at[url_filters_host(u)], at[dst]] += 1
    allowed, blocked, unruled = (np.zeros(len(names)) for _ in range(3))
    for p, u, _ in pages:
        which = {"x.net/es/": blocked, "www.example.com/en/": allowed}.get("/".join(u.split("/")[2:4]) + "/", unruled)
        which[at[url_filters_host(u)]] += 1
    trust = _solved(m, allowed)
    distrust = _solved(m.T, blocked)
    assert blocked.sum() and allowed.sum()
    for p, u, _ in pages:
        k = at[url_filters_host(u)]
        assert got[p].host_trust == pytest.approx(trust[k], abs=1e-4) and got[p].host_distrust == pytest.approx(distrust[k], abs=1e-4)
        if got[p].rule is None:
            share = distrust[k] / (trust[k] + distrust[k] + unruled[k])
            if abs(share - 0.5) > 1e-4:
                assert (got[p].verdict == "block") == (distrust[k] > 0 and share >= 0.5)


def url_filters_host(url):
    return url.split("/")[2].lower()


def _solved(m, seed):
    share = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
    x = seed.copy()
    for _ in range(400):
        x = seed + 0.85 * x @ share
    return x


# Rules, classifier, secrets ----------------------------------------------------------------------------------------------


def test_case_when_equals_a_walk_over_the_rules(spark):
    sf = SF.replace("0.001", "0.01")
    known = spark.read.parquet(f"{sf}/labels.parquet")
    docs = duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet'").fetchall()  # noqa: F811
    df = frame(spark, docs + ODD)
    got = quality_rules.judged(df, known).collect()
    stats = common.written(quality_rules.with_statistics(df.select("doc_id", "text")).drop("text"))
    rules = quality_rules.fit(stats, quality_rules.sampled(known)).rules
    by_text = Counter()
    for i, t, _ in docs + ODD:
        s = dict(zip((*quality_rules.COUNTS, *quality_rules.SHARES), quality_rules.statistics(None if t is None else t.encode()), strict=True))
        kept = not (s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"])
        for rule in rules:
            if all(s[c] > x if op == ">" else s[c] <= x for c, op, x in rule):
                kept = False
                break
        by_text[i, kept] += 1
    assert rules and Counter((r.doc_id, r.kept) for r in got) == by_text


def test_rules_end_when_rules_are_made_and_not_when_tries_fail():
    rng = np.random.default_rng(2)
    x = rng.random((6000, 3))
    low = rng.random(6000) < 0.02  # noise, for which no rule is precise
    low |= (x[:, 0] > 0.9) & (x[:, 1] > 0.5)
    rules = quality_rules.learn(x, low, ("a", "b", "c"), np.arange(6000))
    assert rules.rules and len(rules.rules) <= quality_rules.MAX_RULES


def test_ratios_and_weights_are_what_they_should_be():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    y = np.where([(x < 20).sum() > 4 for x in rows], 1.0, -1.0)
    got = classifier.log_count_ratios(rows, y)
    dim = 1 << classifier.DIM_BITS
    p = [1 + sum(k in x.tolist() for x, t in zip(rows, y, strict=True) if t > 0) for k in range(60)]
    q = [1 + sum(k in x.tolist() for x, t in zip(rows, y, strict=True) if t < 0) for k in range(60)]
    total = [sum(len(x) for x, t in zip(rows, y, strict=True) if t * s > 0) + dim for s in (1, -1)]
    assert np.allclose(got[:60], [math.log(a / total[0]) - math.log(b / total[1]) for a, b in zip(p, q, strict=True)])
    values = [got[x] / np.linalg.norm(got[x]) for x in rows]
    cost = np.full(len(rows), 0.7)
    w = classifier.dual_coordinate_descent(rows, values, y, cost, epochs=400)
    primal = lambda w: 0.5 * w @ w + sum(c * max(0.0, 1 - t * (w[x] @ v)) for x, v, t, c in zip(rows, values, y, cost, strict=True))
    best = primal(w)
    for _ in range(300):  # convex: no step in any direction gets lower
        step = np.zeros(dim)
        step[:60] = rng.normal(0, rng.choice([1e-3, 1e-2, 0.1, 1]), 60)
        assert primal(w + step) >= best - 1e-6


def test_live_spans_equal_brute_force(spark, docs):  # noqa: F811
    rng = random.Random(9)
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(30)) for _ in range(12)]
    rows = docs + [(20_000 + i, f"{rng.choice(['see', 'token:', ''])} {rng.choice(keys[: 3 + i % 9])} and {rng.choice(keys)} {i % 4}", f"s{rng.randrange(5)}") for i in range(150)]
    got = Counter((r.doc_id, r.spans, r.n_live, r.n_copied) for r in secret_scan.scan(frame(spark, rows)).collect())
    owners, texts, spans = defaultdict(set), defaultdict(set), {}
    for i, t, s in rows:
        base = brute_secrets(t or "")
        value = {}
        for kind, a, b in base:
            value[kind, a, b] = re.search(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", t[a:b])[1] if kind == "assign" else t[a:b]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", t or ""):
            if all(m.end() <= a or m.start() >= b for _, a, b in base) and looks_drawn(m[0]):
                value["live", m.start(), m.end()] = m[0]
        spans[i] = value
        for v in value.values():
            owners[v].add(s)
            texts[v].add(t)
    order = ("assign", "access", "hex", "live")
    expect = Counter()
    for i, _, _ in rows:
        live = {k for k, v in spans[i].items() if len(owners[v]) <= 3 and len(texts[v]) <= 3}
        shown = sorted((k for k in spans[i] if k[0] != "live" or k in live), key=lambda k: (k[1], order.index(k[0])))
        expect[i, ",".join(f"{k}:{a}:{b}" for k, a, b in shown), sum(k in live for k in shown), sum(k not in live for k in shown)] += 1
    assert got == expect and any(k[2] for k in got) and any(k[3] for k in got)
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert Counter(c.sql(ORACLE_SQL["op7_secret_scans"]).select("doc_id, spans, n_live, n_copied").fetchall()) == expect


def looks_drawn(v):
    lower, upper, digit = (any(c in s for c in v) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    n = Counter(v)
    entropy = sum(c / len(v) * math.log2(len(v) / c) for c in n.values())
    if lower + upper + digit < 2 or (lower + upper + digit == 2 and not re.search(r"[A-Za-z0-9]{24}", v)):
        return False
    if lower and upper and not digit and not any(c.isupper() for c in v[1:]):
        return False
    return entropy >= (3.0 if re.fullmatch(r"[0-9A-F]+|[0-9a-f]+", v) else 3.5)


# Wrappers --------------------------------------------------------------------------------------------------------------


def plain_site(i, rng):
    """A page whose menu, notice and footer are divs without telling names; its paragraphs are its own."""
    body = [f"Paragraph {i} {k} " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) for k in range(rng.randint(1, 5))]
    menu = "".join(f'<div class="m1"><a href="/{w}">{w}</a></div>' for w in ("home", "news", "about"))
    text = "".join(f"<p>{b}</p>" for b in body)
    return body, f'<html><body><div class="q1">{menu}</div><div class="q2">All rights of this site</div><div class="q3"><h1>Title {i}</h1>{text}</div><div class="q4">Imprint<p>and contact</p></div></body></html>'


def test_unnamed_boilerplate_goes_by_the_wrapper(spark):
    rng = random.Random(4)
    made = {i: plain_site(i, rng) for i in range(30)}
    pages = spark.createDataFrame([(i, f"http://plain.net/{i}", page) for i, (_, page) in made.items()], PAGES).repartition(4)
    got = {r.page_id: r.text.split("\n\n") for r in wrappers.main_texts(pages).collect()}
    recall = [len(set(body) & set(got[i])) / len(body) for i, (body, _) in made.items()]
    assert np.mean(recall) >= 0.9
    assert all(set(got[i]) <= {*body, f"Title {i}"} for i, (body, _) in made.items())
    assert all("\n\n".join(got[i]) != wrappers.extract(page) for i, (_, page) in made.items())  # without the wrapper: the boilerplate, too


def test_all_articles_and_only_menus_of_links():
    two = "<body><article><p>first part</p></article><div>between</div><article><p>second part, a bit longer</p></article></body>"
    assert wrappers.extract(two) == "first part\n\nsecond part, a bit longer"
    share = '<article><p>a</p><div class="share"><p>market share rose</p></div><div class="share"><a href="x">tweet</a> <button>mail</button></div></article>'
    assert wrappers.extract(share) == "a\n\nmarket share rose"


# The pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_counts_and_checksums_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(rans.default_tokenizer())
    text = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = corpus_pipeline.run(spark, SF).collect()
    assert got
    for r in got:
        ids = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shared_folder_is_the_sessions_or_the_contexts(spark):
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    t = common.written(spark.range(3).toDF("x"))
    assert t.count() == 3 and DOC
    common.dropped(t)


# Rows that repeat id and text ------------------------------------------------------------------------------------------


def test_many_copies_of_one_row_have_one_list(spark, monkeypatch):
    """All copies of a row with a null id lose what its text has twice or more; what is told of them is told once."""
    told = []
    plain = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda *a, **k: told.append(plain(*a, **k)) or told[-1])
    text = " ".join(f"word{i % 97}x{i}" for i in range(250))
    rows = [(None, text, "s")] * 300 + [(1, "short", "s")]
    got = suffix_dedup.dedup(frame(spark, rows, extra=False)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(None, len(text)): 300, (1, 0): 1}
    monkeypatch.undo()
    windows = plain(frame(spark, rows[:300], extra=False).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"))
    lists = windows.groupBy("doc_id", "th").agg(F.size(F.collect_set(F.struct("a", "l"))).alias("n"), F.count("*").alias("rows")).collect()
    assert len(lists) == 1 and lists[0].n * 300 == lists[0].rows


# Main texts: what may be dropped, and what may not ----------------------------------------------------------------------


def extracted(spark, pages):
    rows = [(i, f"http://{host}/p{i}", h) for i, (host, h) in enumerate(pages)]
    return {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}


def test_what_articles_share_is_kept(spark):
    shared = [("a.x", f"<body><nav>menu</nav><article><h1>Daily report</h1><p>text {i}</p><blockquote>A quotation.</blockquote></article></body>") for i in range(3)]
    twice = [("b.x", f"<body><div>menu {i}</div><article><h1>Same</h1><p>The same article.</p></article></body>") for i in range(2)]
    parts = [("c.x", f'<body><div class="post text" id="text-1"><p>one {i}</p></div><div class="post text" id="text-2"><p>two {i}</p></div></body>') for i in range(2)]
    login = [("d.x", '<body><article class="login"><p>How to log in.</p></article><article class="comment"><p>A reader.</p></article></body>')]
    got = extracted(spark, shared + twice + parts + login)
    assert [got[i] for i in range(3)] == [f"Daily report\n\ntext {i}\n\nA quotation." for i in range(3)]
    assert got[3] == got[4] == "Same\n\nThe same article."
    assert [got[5], got[6]] == ["one 0\n\ntwo 0", "one 1\n\ntwo 1"]
    assert got[7] == "How to log in."


@pytest.mark.parametrize("n", [2, 5, 20, 60])
def test_unnamed_menu_and_footer_go_whatever_the_bodies_are(spark, n):
    rng = random.Random(n)
    pages, want = [], []
    for i in range(n):
        blocks = [(k, f"{k} {i} {j} word") for j, k in enumerate(rng.choices(["p", "h2", "li", "blockquote"], k=rng.randint(2, 9)))]
        body = "".join(f"<ul><li>{t}</li></ul>" if k == "li" else f"<{k}>{t}</{k}>" for k, t in blocks)
        pages.append(("s.x", f"<html><body><div><ul><li>Home</li><li>About us</li></ul></div><div>{body}</div><div><p>All rights reserved</p><p>Imprint</p></div></body></html>"))
        want.append("\n\n".join(t for _, t in blocks))
    got = extracted(spark, pages)
    assert [got[i] for i in range(n)] == want


def test_numbered_ids_are_one_structure():
    pages = [f'<body><div class="post" id="post-{i}"><p>text {i}</p></div></body>' for i in range(300)]
    assert len({json.dumps([wrappers._key(x) for x in wrappers.stream(p)]) for p in pages}) == 1
    expression = wrappers.infer(pages)
    assert len(expression) < 12 and wrappers.main_region(expression) == "div.post"
