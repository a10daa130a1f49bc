"""op11 to op13 against plain versions, on odd rows and on the small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from asof_spark.llm import conversations, queries, spelling, url_reputation

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- op11


def plain_rule(host, path, rules):
    fits = [(-len(r), -len(r.partition("/")[0]), a != "block", r, a) for a, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return min(fits)[3:] if fits else (None, None)


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG", "http://a.example.org/", "http://example.org/es/1?x=/", "http://example.org?/es/", "x://b.com/fr/#/de/", "x://b.com/de/ü", "x://b.com:80/fr/", "x://evilorg/", "x://b.com/fr", "http://a://b.org/c", "x://" + "a." * 3000 + "org/" + "p" * 20000, "x://É.ORG/\nq", "x://b.com/frx"]


def test_url_rules_on_odd_rows(spark):
    rows = [(i if i % 4 else None, u, "clash") for i, u in enumerate(ODD_URLS + ODD_URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3)
    none = spark.createDataFrame([], "page_id long, good int")
    got = url_reputation.judge_pages(pages, none, queries.URL_RULES).collect()
    want = collections.Counter()
    for i, u, _ in rows:
        host, path = split_url(u)
        rule, action = plain_rule(host, path, queries.URL_RULES)
        want[i, u, host, path, rule, action or "allow"] += 1
    assert collections.Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert got[0].asDict().keys() == {"page_id", "url", "host", "path", "rule", "verdict"}
    assert url_reputation.judge_pages(pages.limit(0), none, queries.URL_RULES).count() == 0


def plain_posteriors(counts):
    """Host to (alpha, beta), by loops."""

    def strength(rows):
        over = sum((g - n * m) ** 2 / (m * (1 - m)) - n for g, n, m in rows if n)
        pairs = sum(n * (n - 1) for _, n, _ in rows if n)
        return 1000.0 if not pairs or over <= 0 else min(1000.0, max(1.0, pairs / over - 1))

    total, n = sum(g for g, _ in counts.values()), sum(n for _, n in counts.values())
    mean = (total + 0.5) / (n + 1)
    domains, suffixes = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    at = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    for h, (g, n) in counts.items():
        for table, key in zip((domains, suffixes), at(h)):
            table[key][0] += g
            table[key][1] += n
    w = strength([(g, n, mean) for g, n in suffixes.values()])
    top = {k: (g + w * mean) / (n + w) for k, (g, n) in suffixes.items()}
    w = strength([(g, n, top[k.split(".")[-1]]) for k, (g, n) in domains.items()])
    share = {k: (g + w * top[k.split(".")[-1]]) / (n + w) for k, (g, n) in domains.items()}
    w = strength([(g, n, share[at(h)[0]]) for h, (g, n) in counts.items()])
    return {h: (g + w * share[at(h)[0]], n - g + w * (1 - share[at(h)[0]])) for h, (g, n) in counts.items()}


def test_host_posteriors_and_bound(spark):
    rng = random.Random(4)
    counts = {f"h{i}.d{i % 7}.{'com' if i % 3 else 'org'}": (0, 0) for i in range(60)}
    counts = {h: (sum(rng.random() < (0.1 if ".d3." in h else 0.9) for _ in range(n)), n) for h, n in ((h, rng.choice([0, 1, 5, 40])) for h in counts)}
    want = plain_posteriors(counts)
    rows = spark.createDataFrame([(h, g, n) for h, (g, n) in counts.items()], "host string, good long, n long")
    got = {r.host: r for r in url_reputation.reputations(rows).collect()}
    assert got.keys() == want.keys()
    draws = np.random.default_rng(1)
    for h, (a, b) in want.items():
        assert (got[h].alpha, got[h].beta) == pytest.approx((a, b), rel=1e-9)
        assert got[h].p_below == pytest.approx((draws.beta(a, b, 40000) < 0.5).mean(), abs=0.02)
    assert {h for h in got if got[h].blocked} and all(".d3." in h for h in got if got[h].blocked)


def test_bad_host_goes_and_a_single_bad_page_does_not(spark):
    pages = [(i, f"http://{'bad.x.net' if i < 60 else f's{i % 40}.y{i % 9}.net'}/p") for i in range(400)] + [(900, "http://once.y1.net/")]
    told = [(i, int(i >= 60)) for i, _ in pages if i != 900] + [(900, 0), (None, 1), (5, None), (12345, 0)]
    got = url_reputation.judge_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(told, "page_id long, good int"), []).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.x.net"}


# ---------------------------------------------------------------- op12


def plain_words(rows, every=31):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def plain_variants(words):
    near = collections.defaultdict(set)
    letters = {c for w in words for c in w}
    for w in words:
        for i in range(len(w)):
            for other in {w[:i] + c + w[i + 1 :] for c in letters} | {w[:i] + w[i + 1 :]}:
                if other != w and other in words:
                    near[w].add(other)
                    near[other].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root)
    return out


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_groups_on_odd_rows(spark):
    rng = random.Random(9)
    rows = []
    for i, (w, n) in enumerate({"reading": 4000, "readings": 300, "readingss": 12, "reeding": 350, "raeding": 9, "éÉcoutez": 50, "écoutez": 600, "listens": 40, "silents": 4, "banana": 500, "bananas": 7, "aaaaaaa": 30, "aaaaaaaa": 3, "a" * 3000: 2, "a" * 2999: 40}.items()):
        rows += [(i, f"{w} 1 {w.upper() if w.isascii() else w}-") for _ in range(n // 2)]
    rows += [(None, "Reading reeding"), (7, None), (8, ""), (9, "..."), (2**53 + 1, "reading"), (None, "x " * 50000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string").repartition(4)
    words = spelling.count_words(spelling.misspell(spelling.runs(docs)))
    want = plain_variants(plain_words(rows))
    assert found(spelling.group_variants(words)) == want
    assert any(f != r for _, _, f, _, r in want.values() if f)
    assert spelling.group_variants(spelling.count_words(spelling.misspell(spelling.runs(docs.limit(0))))).count() == 0


def test_spelling_signatures_miss_no_pair(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 9))) for _ in range(300)}
    for w in list(words):
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + rng.choice("abcdefÿ") + w[i:], w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]}
    table = {w: rng.choice([2, 3, 30, 300]) for w in words if len(w) >= 7}
    got = found(spelling.group_variants(spark.createDataFrame(list(table.items()), "word string, n long")))
    assert got == plain_variants(table)


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op12_spelling(spark, SF)) == plain_variants(plain_words(docs))


# ---------------------------------------------------------------- op13

SPACE = " \t\n\x0b\x0c\r"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def closed(best):
    """Every state with its best (cost, audit, lines), insertions before what follows allowed."""
    for _ in range(4):
        for q, role in NEEDED.items():
            if STEPS[q, role[0]] in best:
                cost, audit, lines = best[STEPS[q, role[0]]]
                best[q] = min(best.get(q, (10**9, "", [])), (cost + 2, "I" + audit, [role + ":", *lines]), key=lambda x: x[:2])
    return best


def plain_repair(conv, rows):
    own = lambda r, x: hashlib.sha256(":".join(["true" if conv is None else "false", "" if conv is None else str(conv), str(len(r)), r, x]).encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], own(r[1], r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    best = closed({0: (0, "", []), 3: (0, "", [])})
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault in ("", "truncated"):
                more, needed = int(fault == "truncated"), NEEDED[q]
                if (q, role[:1]) in STEPS:
                    cost, audit, lines = best[STEPS[q, role[:1]]]
                    ways.append((cost + more, "K" + audit, [f"{role}:{text}", *lines]))
                cost, audit, lines = best[STEPS[q, needed[0]]]
                ways.append((cost + more + 2, "R" + audit, [f"{needed}:{text}", *lines]))
            now[q] = min(ways, key=lambda x: x[:2])
        best = closed(now)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = best[0] if rows else (0, "", [])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df, **kw):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in conversations.repair(conversations.damage(df), times_col="times", **kw).collect()}


def plain(rows):
    damaged = plain_damage(rows)
    return {c: plain_repair(c, damaged[c]) for c in {r[0] for r in rows}}


CONVERSATIONS = "conv_id long, turn long, role string, text string"
ROLES = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "usher"]
TEXTS = ["a.", "b", "b!", " ", "", "c?  ", "no end", None, "x.\u2003", "yy.\n", "\u00a0", "z" * 50000]


def test_repair_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None, 5, 6, 7, 2**53 + 1]), rng.choice([None, *range(11), 20]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(400)]
    df = spark.createDataFrame([(*r, 5) for r in rows], CONVERSATIONS + ", audit int").repartition(3)
    assert repaired(df) == plain(rows)
    assert repaired(df.limit(0)) == {}
    # a conversation whose only row is dropped
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "a.")], CONVERSATIONS)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repair_of_a_conversation_over_many_tasks_and_pieces(spark):
    rng = random.Random(5)
    rows = [(1, i // 2, rng.choice(ROLES), (rng.choice(TEXTS[:8]) or "") + str(rng.randrange(1500))) for i in range(1500)]
    rows += [(2, 1, "user", "hot.")] * 400 + [(3, None, "user", "q")] * 300 + [(4, 3, "user", "q."), (4, 4, "assistant", "a.")]
    rows += [(c, t, "ua"[t % 2] + "x", f"{c}.") for c in range(5, 60) for t in range(4)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    assert repaired(df, piece_rows=7) == repaired(df) == plain(rows)


def test_block_tables_give_the_costs_of_single_steps():
    vectors, numbers, single, blocks = conversations.tables()
    assert len(vectors) < 64 and len(blocks[0]) == 9**conversations.BLOCK
    rng = random.Random(1)
    for n in range(40):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        costs = list(conversations.END)
        for s in reversed(symbols):
            costs = conversations._before(s, costs)
        assert list(conversations.walk(symbols, conversations.END)[1]) == costs


def test_repair_query_and_turns(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in RESULT) for r in queries.op13_conversation_repair(spark, SF).collect()} == plain(rows)
    turns = conversations.repair(spark.createDataFrame(rows, CONVERSATIONS), with_turns=True).collect()
    for r in turns:
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.repaired).encode()).hexdigest() == r.repaired_sha256
