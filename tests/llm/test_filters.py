import os
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoview.llm import chat, decontam, url_filter
from geoview.llm.queries import QUERIES


def windows(text, size):
    w = re.findall(r"\w+", (text or "").lower())
    for at in range(max(1, len(w) - size + 1)):
        yield at, w[at : at + size]


def shingles(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute_force(docs, items, threshold=0.8):
    found = set()
    for doc_id, text in docs:
        for item_id, item in items:
            w = re.findall(r"\w+", (item or "").lower())
            b = shingles(w)
            if not w:
                continue
            best = max((sum((a & b).values()) / max(1, sum((a | b).values())) for _, x in windows(text, len(w)) if (a := shingles(x))), default=0)
            if best >= threshold:
                found.add((doc_id, item_id, round(best, 9)))
    return found


def leaks(docs, items):
    rows = decontam.with_leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).collect()
    return {(r["doc_id"], r["l"]["item_id"], round(r["l"]["similarity"], 9)) for r in rows}


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def test_leaks_against_brute_force(spark):
    changed = ITEM.replace("nineteen twenty one", "nineteen 20 one", 1)
    texts = ["noise a b c " + ITEM + " more noise", "PRE, " + ITEM.upper().replace(" ", ",  ") + "!", changed + " tail words here", " ".join(ITEM.split()[:15]), "short item", "a short item!", "nothing in common at all here today", None, "", ITEM * 3, " ".join(reversed(ITEM.split()))]
    docs = list(enumerate(texts))
    items = [(1, ITEM), (2, "short item"), (3, None), (4, ""), (5, "wholly other words that stand nowhere else"), (6, ITEM)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute_force(docs, items) and {(0, 1, 1.0), (1, 1, 1.0), (4, 2, 1.0)} <= got


def test_benchmark_in_parts(spark, sf_dir, docs, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    some = docs.limit(60)
    want = leaks(some, items)
    monkeypatch.setattr(decontam, "PART_CHARS", 2000)
    assert leaks(some, items) == want


def test_recall_of_fingerprints(spark):
    """Passages of similarity 0.8 to 1, against brute force."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((30, 60, 120))))) for i in range(15)]
    docs = []
    for i in range(150):
        w = items[i % 15][1].split()
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join([word() for _ in range(rng.randrange(40))] + w + [word() for _ in range(rng.randrange(40))])))
    want = brute_force(docs, items)
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len([1 for *_, s in want if s < 0.9]) > 20 and got <= want
    assert len(got) >= 0.98 * len(want)


def test_repeated_items_report_each(spark, monkeypatch):
    docs = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, "short")], "item_id long, text string")
    for chars in (decontam.PART_CHARS, 100):
        monkeypatch.setattr(decontam, "PART_CHARS", chars)
        got = [(r["doc_id"], sorted(str(x["item_id"]) for x in r["leaks"])) for r in decontam.with_leaks(docs, items).orderBy("doc_id").collect()]
        assert got == [(0, ["1", "1", "None"])] * 2 + [(1, [])]


def test_long_texts_and_many_items_stay_small():
    """20,000 items of one size and a text of 50 MB, in a process of its own."""
    code = """
import random, resource
from geoview.llm import decontam
from geoview.llm.shingles import words_of
rng = random.Random(1)
words = ["word%d" % i for i in range(4000)]
items = [(i, " ".join(rng.choices(words, k=60)), 1) for i in range(20000)]
bench = decontam.Benchmark(items)
block = " ".join(rng.choices(words, k=100000)) + " "
text = block * (50_000_000 // len(block) + 1) + items[7][1] + " " + items[19999][1]
found = bench.leaks(words_of(text), 0.8)
assert {(i, s) for i, _, _, s in found} == {(7, 1.0), (19999, 1.0)}, found[:5]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": os.getcwd()})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000


def test_leaks_edge_cases(spark, odd_docs, no_docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontam.with_leaks(odd_docs, items)
    assert out.count() == odd_docs.count() and sorted(out.columns) == sorted(odd_docs.columns)
    assert decontam.with_leaks(no_docs, items).count() == 0
    assert decontam.with_leaks(odd_docs, items.limit(0)).filter(F.size("leaks") > 0).count() == 0


def test_planted_passages_are_found(spark, sf_dir, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if f" {flat(t)} " in f" {flat(r['text'])} "}
    got = {(d, i) for d, i, s in ((r["doc_id"], r["item_id"], r["similarity"]) for r in QUERIES["op5_decontamination"](spark, sf_dir).collect())}
    assert want <= got


RULES = [url_filter.Rule("block", "com/en/"), url_filter.Rule("allow", "example.com/en/7"), url_filter.Rule("allow", "net/de/"), url_filter.Rule("block", "example.net/de/8"), url_filter.Rule("block", "org/es/")]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "http://A.Example.COM/en/71?x#y", "x://example.com?/en/7", "http://xexample.com/en/7", "https://com/en/", "ftp://a.net/de/8#/q", "http://b.example.net/de/8/a/b/c/d/e/f/g/h", "http://É.org/es//", "a://b://c.org/es/1", "http://h.org/a%20b/é/" + "z" * 500]
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(odd + odd)], "page_id long, url string, html string, host string, n int")
    got = url_filter.judge_urls(pages, RULES).collect()
    assert len(got) == len(odd) * 2
    for r in [*got, *QUERIES["op3_url_filter"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()]:
        url = r["url"] if "url" in r.asDict() else (odd + odd)[r["page_id"]]
        host, path, rule = by_hand(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None), url
        assert r["verdict"] == (rule.verdict if rule else "block" if r["purity"] >= url_filter.REJECT else "allow")
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_templates(spark):
    rows = [("http://h.com/user/u%s/post/%d" % ("abcdefghijklmnopqrstuvwxyz"[i % 26] * (i % 5 + 1), i)) for i in range(400)] + ["http://h.com/bad/%d" % i for i in range(50)] + ["http://other.com/bad/%d" % i for i in range(5)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = url_filter.judge_urls(pages, [url_filter.Rule("block", "h.com/bad/1"), url_filter.Rule("block", "h.com/bad/2"), url_filter.Rule("block", "h.com/bad/3")]).collect()
    by = {}
    for r in got:
        by.setdefault((r["host"], r["path"].split("/")[1]), set()).add((r["template"], r["verdict"]))
    users = {t for t, _ in by[("h.com", "user")]}
    assert len(users) <= 3 and all(v == "allow" for _, v in by[("h.com", "user")])
    assert {v for _, v in by[("h.com", "bad")]} == {"block"} and {v for _, v in by[("other.com", "bad")]} == {"allow"}


def test_templates_tell_long_and_deep_siblings_apart(spark):
    ways = {"long": "/" + "z" * 40, "deep": "/s" * 8 + "/"}
    rows = [(way + end, f"http://h.com{at}{end}/{i}") for way, at in ways.items() for end in ("bad", "fine") for i in range(50)]
    alone = "/q" + "/x" * 30 + "/" + "y" * 300
    rows.append(("alone", f"http://other.com{alone}"))
    pages = spark.createDataFrame(rows, "page_id string, url string")
    rules = [url_filter.Rule("block", f"h.com{at}bad/{n}") for at in ways.values() for n in (1, 2, 3)]
    by = {}
    for r in url_filter.judge_urls(pages, rules).collect():
        by.setdefault(r["page_id"], set()).add((r["template"], r["verdict"]))
    for way in ways:
        assert {v for _, v in by[way + "bad"]} == {"block"} and {v for _, v in by[way + "fine"]} == {"allow"}
        assert not {t for t, _ in by[way + "bad"]} & {t for t, _ in by[way + "fine"]}
    assert {t for t, _ in by["alone"]} == {alone}


def test_large_class_paths_are_not_broadcast(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr) == want


def test_joins_instead_of_broadcasts_change_nothing(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr) == want


def test_many_rules_as_a_table(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr)
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert sorted(map(tuple, url_filter.judge_urls(pages, RULES).collect()), key=repr) == want
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages.withColumnRenamed("page_id", "host"), RULES, id_col="host")


def tree_by_hand(paths):
    """Template of each (host, classes) from rows (host, classes, n, bad, good)."""
    done = {}
    work = [(h, "", [([s for s in c.split("/") if s], c, n, b, g) for hh, c, n, b, g in paths if hh == h]) for h in sorted({p[0] for p in paths})]
    while work:
        host, at, rows = work.pop()
        done.update({(host, c): at for left, c, *_ in rows if not left})
        rows = [r for r in rows if r[0]]
        if len(rows) == 1:
            left, c, *_ = rows[0]
            done[(host, c)] = "/".join([at, *left])
            continue
        pages = Counter()
        for left, _, n, _, _ in rows:
            pages[left[0]] += n
        many = len(pages) > url_filter.MANY_CHILDREN
        name = {s: "?*" if many and n < url_filter.RARE_SHARE * sum(pages.values()) else s for s, n in pages.items()}
        bad, good = Counter(), Counter()
        for left, _, _, b, g in rows:
            bad[name[left[0]]] += b
            good[name[left[0]]] += g
        names = sorted(set(name.values()), key=lambda x: ((bad[x] + 0.4) / (bad[x] + good[x] + 4.0), x))
        groups = [(x,) for x in names]

        def far(xs, ys):
            m, n = (sum(bad[x] + good[x] for x in some) for some in (xs, ys))
            p, q = (sum(bad[x] for x in some) / k if k else 0.1 for some, k in ((xs, m), (ys, n)))
            m, n = m or 4.0, n or 4.0
            pq = (p * m + q * n) / (m + n)
            return (p - q) ** 2 / (pq * (1 - pq) * (1 / m + 1 / n)) if 1e-12 < pq < 1 - 1e-12 else 0.0

        while True:
            near = [(max([far(g, h)] + [far((x,), (y,)) for x in g for y in h]), i) for i, (g, h) in enumerate(zip(groups, groups[1:]))]
            if not near or min(near)[0] > 3.841:
                break
            i = min(near)[1]
            groups = groups[:i] + [groups[i] + groups[i + 1]] + groups[i + 2 :]
        cluster = {x: k for k, g in enumerate(groups, 1) for x in g}
        final = {x: f"?{cluster[x]}" if list(cluster.values()).count(cluster[x]) > 1 else x for x in names}
        below = {}
        for left, *r in rows:
            below.setdefault("/".join([at, final[name[left[0]]]]), []).append((left[1:], *r))
        work += [(host, t, some) for t, some in below.items()]
    return done


def test_templates_against_a_tree_by_hand(spark):
    rng = random.Random(5)
    rows = []
    for host in ("a.com", "b.com"):
        for s in ("news", "shop", "casino", "pills", "blog", "*", "?", "~", "{n}"):
            for i in range(rng.randint(5, 40)):
                rows.append((host, f"{s}/{rng.choice(['x', 'y', 'z'])}/{rng.choice('abcdefghijklmnopqrstuvwxyz')}", s))
    counts = Counter()
    for host, c, s in rows:
        counts[(host, c, s)] += 1
    paths = [(h, c, n, n if s == "casino" else n // 2 if s == "pills" else 0, n if s in ("news", "blog") else 0) for (h, c, s), n in sorted(counts.items())]
    df = spark.createDataFrame(paths, "host string, classes string, n long, bad long, good long")
    got = {(r["host"], r["classes"]): r["template"] for r in url_filter.templates(df).collect()}
    assert got == tree_by_hand(paths)
    by = {}
    for r in url_filter.templates(df).collect():
        by.setdefault(r["classes"].split("/")[0], set()).add(r["purity"] >= url_filter.REJECT)
    assert by["casino"] == {True} and by["news"] == by["blog"] == by["shop"] == {False}


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "assistant", "no"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (None, 0, "user", "lost"), (7, None, "user", "b"), (7, None, "user", "a"), (7, None, "user", "a"),
    ]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, side int")
    got = {r["pair_id"]: r for r in chat.format_neighbours(table).collect()}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\ngood<|end|>\n" and got[0]["prefix_turns"] == 2
    assert got[0]["rejected"] == "<|assistant|>\nno<|end|>\n"
    lo, hi = map(int, got[0]["rejected_spans"].split("-"))
    assert got[0]["rejected"][lo:hi] == "no<|end|>\n"
    a, b = got[0]["chosen"], got[0]["chosen_spans"]
    assert [a[slice(*map(int, s.split("-")))] for s in b.split(",")] == ["yes<|end|>\n"]
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["chosen_spans"]) == ("", "", "")
    assert got[2]["chosen"] == "<|unknown|>\n<|end|>\n" and got[2]["rejected"] is None and got[2]["prompt"] == ""
    assert got[3]["rejected"].count("<|user|>\na") == 2 and got[3]["chosen"] is None
    assert set(got) == {0, 1, 2, 3} and chat.format_neighbours(table.limit(0)).count() == 0
    pairs = spark.createDataFrame([(9, 1, 0)], "pair_id long, chosen_id long, rejected_id long")
    row = chat.format_preferences(table, pairs).first()
    assert (row["pair_id"], row["chosen_id"], row["prompt"]) == (9, 1, got[0]["prompt"]) and row["chosen"] == got[0]["rejected"]


def test_preferences_equal_their_sql(spark, sf_dir):
    import duckdb

    from geoview.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = con.execute(ORACLE_SQL["op10_preferences"])
    names = [d[0] for d in want.description]
    got = QUERIES["op10_preferences"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_merging_does_not_chain():
    """Of 20 branches with bad shares from 0 to 95 in steps of 5, none over a half
    lands in a template under it, and no template spans branches that differ."""
    from geoview.llm import url_filter as u

    bad = [10 * i for i in range(20)]
    good = [200 - b for b in bad]
    number = u.merge_branches(bad, good)
    assert sorted(set(number)) == list(range(1, max(number) + 1)) and number == sorted(number) and 5 <= max(number) < 20
    for k in set(number):
        own = [i for i, x in enumerate(number) if x == k]
        purity = (sum(bad[i] for i in own) + u.PRIOR_WEIGHT * u.PRIOR_BAD) / (200 * len(own) + u.PRIOR_WEIGHT)
        assert all((bad[i] > 100) <= (purity >= u.REJECT) for i in own if bad[i] != 100)
        assert max(own) - min(own) <= 2
    assert u.merge_branches([], []) == [] and u.merge_branches([3], [0]) == [1]
    assert len(set(u.merge_branches([0] * 9, [50] * 9))) == 1


def test_branches_over_a_half_stay_blocked(spark):
    from geoview.llm import url_filter as u

    share = F.col("id") % 20 * 10
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.when(F.floor(F.col("id") / 20) < share, "http://bad.h.com/s").otherwise("http://h.com/s"), F.chr(F.lit(97) + F.col("id") % 20)).alias("url"))
    # Labels come by host, so the tree is tried on its own table of one host.
    paths = pages.select(F.lit("h").alias("host"), F.concat(F.lit("s"), F.chr(F.lit(97) + F.col("page_id") % 20)).alias("classes"), F.col("url").startswith("http://bad").cast("long").alias("bad"))
    paths = paths.groupBy("host", "classes").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).withColumn("good", F.col("n") - F.col("bad"))
    got = {r["classes"]: r["purity"] for r in u.templates(paths).collect()}
    assert len(got) == 20 and all(got[f"s{chr(97 + i)}"] >= 0.5 for i in range(11, 20)) and all(got[f"s{chr(97 + i)}"] < 0.5 for i in range(10))


def test_long_shared_paths_take_few_rounds(spark):
    import time

    from geoview.llm import url_filter as u

    deep = "/".join(["a"] * 1000)
    rows = [("h", f"{deep}/x/y", 1, 1, 0), ("h", f"{deep}/z", 1, 0, 1), ("h", "a", 1, 0, 0), ("g", deep, 2, 0, 2), ("e", "", 1, 0, 0)]
    start = time.time()
    got = {(r["host"], r["classes"]): r["template"] for r in u.templates(spark.createDataFrame(rows, "host string, classes string, n long, bad long, good long")).collect()}
    assert time.time() - start < 60 and len(got) == 5
    assert got["e", ""] == "" and got["g", deep] == "/" + deep and got["h", "a"] == "/a"
    assert all(got["h", f"{deep}/{x}"].startswith("/" + deep + "/") for x in ("x/y", "z"))


def test_near_equal_items_are_compared_in_blocks():
    """A document against 2,000 items that differ in a word or two."""
    import time

    import numpy as np

    from geoview.llm import decontam as d

    r = np.random.default_rng(3)
    base = [f"w{i}" for i in r.integers(0, 5000, 40)]
    items = []
    for i in range(2000):
        words = list(base)
        for at in r.integers(0, 40, 2):
            words[at] = f"x{i}"
        items.append((i, " ".join(words), 1))
    bench = d.Benchmark(items)
    words = d.word_hashes([" ".join([f"w{i}" for i in r.integers(0, 5000, 600)] + base + [f"w{i}" for i in r.integers(0, 5000, 560)])])[0]
    start = time.time()
    found = bench.leaks(words, 0.5)
    assert time.time() - start < 2.0
    from collections import Counter

    own = Counter(d.shingle_hashes(words[600:640]).tolist())
    want = set()
    for i, t, _ in items[:300]:
        other = Counter(d.shingle_hashes(d.word_hashes([t])[0]).tolist())
        both = sum((own & other).values())
        if both / (72 - both) >= 0.8:
            want.add((i, round(both / (72 - both), 9)))
    assert {(i, round(x, 9)) for i, _, _, x in found if i < 300 and x >= 0.8} == want and len(want) > 3
    assert all(590 <= at <= 610 for _, at, _, x in found if x >= 0.8)


def test_sample_of_a_very_large_language():
    from geoview.llm import langid

    for rows in (10**3, 10**9, 5 * 10**10):
        chance = langid.chosen_below(rows) / langid.PLACES
        assert abs(min(rows, chance * rows) - min(rows, langid.SAMPLE_ROWS)) < 1
    # So many places are below the bound that rows of the sample hardly meet in one.
    assert langid.chosen_below(5 * 10**10) > 1e10
