import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from glossa.llm import chat_snapshots as C
from glossa.llm import url_lists as U


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def test_maximal_conversations_equal_brute_force(spark):
    rng = random.Random(2)
    talks = []
    for _ in range(60):
        full = [("user" if i % 2 == 0 else "assistant", rng.choice("abc")) for i in range(rng.randint(1, 9))]
        talks += [full[: rng.randint(1, len(full))] for _ in range(rng.randint(1, 3))] + [full]
    talks += [[("user", "same")]] * 50
    talks += [[("user", str(i)) for i in range(700)], [("user", str(i)) for i in range(300)]]  # several blocks
    rows = [(i, k + (i % 3), r, t) for i, talk in enumerate(talks) for k, (r, t) in enumerate(talk)]
    rng.shuffle(rows)
    keys = [tuple(t) for t in talks]
    prefixes = {k[:n] for k in keys for n in range(1, len(k))}
    want = {min(i for i, x in enumerate(keys) if x == k): keys.count(k) for k in set(keys) if k not in prefixes}
    got = C.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.n_copies for r in got} == want
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.part)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    assert all(whole[i] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talks[i]) for i in want)


def test_chat_edges(spark):
    rows = [(None, 1, "user", "x", 1), (1, None, None, None, 1), (1, 0, "user", "<|im_end|>", 1), (1, 0, "user", "<|im_end|>", 1), (2, 0, "user", "<|im_end|>", 1)]
    got = C.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).orderBy("part").collect()
    assert [r.conv_id for r in got] == [1] and {r.n_turns for r in got} == {2}
    assert "".join(r.text for r in got) == "<|im_start|>user\n< |im_end|><|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"
    assert C.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_without_a_turn_and_ties_are_split_and_ordered(spark, monkeypatch):
    """One conversation of 900 rows that all lack a turn, over several range partitions and parts; ties follow role and md5."""
    monkeypatch.setattr(C, "PART", 100)
    rows = [(7, None, "user" if i % 2 else "assistant", f"t{i}") for i in range(900)] + [(8, 0, "user", "x"), (8, 0, "user", "y")]
    got = C.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    want = [t for _, _, t in sorted((r, hashlib.md5(t.encode()).hexdigest(), t) for c, _, r, t in rows if c == 7)]
    texts = "".join(r.text for r in sorted((r for r in got if r.conv_id == 7), key=lambda r: r.part))
    assert re.findall(r"\n(t\d+)<", texts) == want and len(got) == 10


def test_log_of_snapshots_collapses_to_its_conversations(spark):
    rows = [(c, k, ("user", "assistant")[k % 2], f"{c} {k}") for c in range(20) for k in range(1 + c % 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = C.sample_log(turns)
    assert log.select("conv_id").distinct().count() > 40
    assert {r.conv_id: r.n_copies for r in C.collapse(log).collect()} == {3 * c: 2 if c % 5 == 1 else 1 for c in range(20)}


def active(entries, rule, at):
    state = None
    for d in sorted({e[2] for e in entries if e[0] == rule}):
        if d <= at:
            adds = [e for e in entries if e[0] == rule and e[2] == d and e[1] == "add"]
            state = (d, max(e[3] for e in adds)) if adds else None
    return state


def test_judgements_equal_brute_force(spark):
    rng = random.Random(4)
    rules = ["example.com", "a.example.com", "b.org", "b.org/x", "b.org/x/y", "org"]
    entries = [(rng.choice(rules), rng.choice(["add", "remove"]), day(rng.randint(0, 40)), rng.choice("pq")) for _ in range(40)]
    urls = ["http://a.example.com/p", "https://U@b.org:80/x/y/z?q", "http://B.ORG/x", "http://b.org", "ftp://c.net/", "notexample.com", "http://notexample.com/", None, ""]
    caps = [(i, rng.choice(urls), day(rng.randint(-2, 45)), "k") for i in range(300)] + [(900, "http://b.org/x", None, "k")]
    hosts = {"http://a.example.com/p": ["example.com", "a.example.com"], "https://U@b.org:80/x/y/z?q": ["b.org", "org", "b.org/x", "b.org/x/y"], "http://B.ORG/x": ["b.org", "org", "b.org/x"], "http://b.org": ["b.org", "org"]}
    df = spark.createDataFrame(caps, "page_id long, url string, fetched date, rule string")
    log = spark.createDataFrame(entries + [(None, "add", day(1), "p"), ("x", "what", day(1), "p"), ("x", "add", None, "p")], "rule string, action string, day date, category string")
    got = {r.page_id: (r.blocked, r.rule, r.category, r.listed_since, r.n_rules) for r in U.judge(df, log).collect()}
    for i, url, at, _ in caps:
        hits = {r: active(entries, r, at) for r in hosts.get(url, [])} if at else {}
        hits = {r: s for r, s in hits.items() if s}
        best = min(hits, key=lambda r: (-len(r), r), default=None)
        assert got[i] == ((True, best, hits[best][1], hits[best][0], len(hits)) if best else (False, None, None, None, 0)), (url, at)
    assert U.judge(df.limit(0), log).count() == 0
    assert U.judge(df, log.limit(0)).where("blocked").count() == 0


def test_repeated_captures_repeat(spark):
    df = spark.createDataFrame([(1, "http://b.org", day(3))] * 4, "page_id long, url string, fetched date")
    log = spark.createDataFrame([("b.org", "add", day(1), "p")], "rule string, action string, day date, category string")
    assert [r.blocked for r in U.judge(df, log).collect()] == [True] * 4
    assert U.intervals(log.unionByName(log).unionByName(log.withColumn("action", F.lit("remove")).withColumn("day", F.lit(day(9))))).collect() == [("b.org", day(1), day(9), "p")]
