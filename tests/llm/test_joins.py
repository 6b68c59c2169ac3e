"""Joins, components, vectors, personal data and address lists against brute force."""

import math
import random
import re

import numpy as np
from conftest import DATA

from deskbook.llm import common, ngramjoin, pii, urlfilter, vectors
from deskbook.llm.oracles import OP5_SQL

R = random.Random(6)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202)]
    R.shuffle(edges)
    want = Union(x for e in edges for x in e)
    for a, b in edges:
        want.link(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want.find(i) for i in want.up if i != 200}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, q):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(words)] if 0 < len(words) < q else [tuple(words[i : i + q]) for i in range(len(words) - q + 1)]) if words else frozenset()


def test_jaccard_components(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "a B")]
    for _ in range(40):
        base = [R.choice("abcdefghijklmnopqrstuvwxyz") * R.randint(1, 3) for _ in range(R.choice([5, 8, 12, 20, 60, 200]))]
        for _ in range(R.randint(1, 7)):
            own = list(base)
            for _ in range(R.randint(0, max(1, len(base) // 40))):
                own[R.randrange(len(own))] = R.choice("xyz")
            rows.append((len(rows) * 3 + 7, " ".join(own)))
    sim = ngramjoin.Similarity()
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = Union(sets)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.link(a, b)
    df = spark.createDataFrame([*rows, rows[10]], "doc_id long, text string")
    got = ngramjoin.jaccard_components(df, sim).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want.find(i)) for i, s in sets.items()}


def test_table_united_with_itself(spark):
    own, rows = random.Random(8), []
    for size in (60, 100, 200):
        for _ in range(25):  # each next text differs from the one before by a word or two more than the last
            text = [f"w{own.randrange(10**6)}" for _ in range(size)]
            for _ in range(8):
                rows.append((len(rows), " ".join(text)))
                for _ in range(own.randint(1, max(1, size // 50))):
                    text[own.randrange(size)] = f"w{own.randrange(10**6)}"
    sim = ngramjoin.Similarity()
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = Union(sets)
    for a in sets:
        for b in range(a + 1, (a // 8 + 1) * 8):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.link(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngramjoin.jaccard_components(df.union(df), sim).collect()
    assert len(got) == 2 * len(rows) and {r.doc_id: r.component_id for r in got} == {i: want.find(i) for i in sets}


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text, 1), (7, text + " more", 1), (9, "other text here", 1), (9, "other text here", 1), (11, None, 1), (None, "x", 1)], "doc_id long, text string, component_id int")
    kept = ngramjoin.keep_one(df, ngramjoin.Similarity(5, 80, 100))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [11, 5, 9, None] and kept.columns == df.columns
    assert ngramjoin.keep_one(df.limit(0), ngramjoin.Similarity()).count() == 0


def test_linked_light_sets_share_a_subset():
    sim = ngramjoin.Similarity()
    for _ in range(300):
        n = R.randint(1, 12)
        a = np.unique(np.array([R.getrandbits(63) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[R.randint(0, 2) :], np.array([R.getrandbits(63) for _ in range(R.randint(0, 2))], np.uint64)]))
        both = len(np.intersect1d(a, b))
        linked = len(b) and both and 100 * both >= 85 * (len(a) + len(b) - both)
        shared = len(b) and len(np.intersect1d(ngramjoin.subset_keys(a, sim), ngramjoin.subset_keys(b, sim)))
        assert shared or not linked


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [*base, *(base[:25] + 0.05 * rng.standard_normal((25, 16))), *(base[:10] * 3), *base[:5]]
    rows = [[float(np.float32(v)) for v in r] for r in rows]
    bad = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [None] + [1.0] * 15, [math.inf] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows + bad)), "vec_id long, embedding array<float>")
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = Union(range(len(rows) + len(bad)))
    for a, b in zip(*np.nonzero(close)):
        want.link(int(a), int(b))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    links = [*close.sum(axis=1).tolist(), *[0] * len(bad)]
    assert got == {i: (links[i], want.find(i), want.find(i) == i) for i in range(len(links))}


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = np.ones((50, 16)) + 0.02 * rng.standard_normal((50, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()} == {(49, 0)}


def spread(rng, base, n, angle):
    """``n`` unit rows at ``angle`` from ``base``."""
    away = rng.standard_normal((n, len(base)))
    away -= (away @ base)[:, None] * base
    return math.cos(angle) * base + math.sin(angle) * away / np.linalg.norm(away, axis=1, keepdims=True)


def brute_vectors(x):
    close = np.triu(x @ x.T >= 0.95, 1)
    want = Union(range(len(x)))
    for a, b in zip(*np.nonzero(close)):
        want.link(int(a), int(b))
    return {i: (int(n), want.find(i)) for i, n in enumerate(close.sum(axis=0) + close.sum(axis=1))}


def found_vectors(spark, x):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}


def test_components_that_share_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(21)
    first = np.eye(16)[0] + 0.01
    first /= np.linalg.norm(first)
    second = spread(rng, first, 1, 0.45)[0]  # too far from the first, in its buckets
    chain = [first * math.cos(a) + (second - first * (second @ first)) / np.linalg.norm(second - first * (second @ first)) * math.sin(a) for a in (-0.3, -0.6, -0.9)]
    x = np.vstack([spread(rng, first, 40, 0.05), spread(rng, second, 30, 0.05), spread(rng, first, 30, 0.3), chain])
    x = x[rng.permutation(len(x))]
    assert found_vectors(spark, x) == brute_vectors(x)


def test_dense_bucket_at_its_real_size(spark):
    rng = np.random.default_rng(22)
    base = np.eye(32)[3] + 0.02
    x = np.vstack([spread(rng, base / np.linalg.norm(base), 2 * vectors.BLOCK + 500, 0.1), rng.standard_normal((50, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert found_vectors(spark, x) == brute_vectors(x)


def test_vectors_of_a_table_with_links(spark, duck, tmp_path):
    rng = np.random.default_rng(9)
    table = [[float(v) for v in r.embedding] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("embedding").collect()]
    rows = [np.array(r) for r in table[:60]]
    for k in range(12):  # chains and tight groups, exact copies among them
        base = np.array(table[k])
        noise = lambda c: c * np.linalg.norm(base) * (v := rng.standard_normal(len(base))) / np.linalg.norm(v)
        rows += [base + noise(0.05) for _ in range(k)] + [base + noise(0.3) for _ in range(k)] + [base] * (k % 3)
    rows = [[float(np.float32(v)) for v in r] for r in rows]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, component_id string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duck.cursor()
    con.execute(f"create temp view planted as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(OP5_SQL.replace("from embeddings", "from planted")).fetchall()
    got = vectors.op5_embedding_near_dup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_links for r in got) > 100
    empty = vectors.near_duplicates(df.limit(0))
    assert empty.count() == 0 and vectors.near_duplicates(df.unionByName(df)).count() == 2 * len(rows)


def test_recall_just_above_the_threshold(spark):
    rng, pairs = np.random.default_rng(12), []
    for _ in range(1000):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        c = rng.uniform(0.951, 0.96)
        pairs += [a, c * a + math.sqrt(1 - c * c) * b]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>")
    found = vectors.near_duplicates(df).where("n_links > 0").count() / len(pairs)
    print("recall", found)
    assert found >= 0.95


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_pii(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(spark):
    bits = ["a", "b.", "@", "1", "22", "4111111111111111", "5500-0000-0000-0004", ".", "-", " ", "+1", "(", "é", "😀", "\n", "255", "_", "%"]
    texts = [None, "", "a@b.com_c@d.org", "1" * 9000, "1 " * 6000, "a.b@" + "c." * 4000 + "d", *("".join(R.choice(bits) for _ in range(R.randint(0, 40))) for _ in range(500))]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all([(s.kind, s.start, s.end) for s in r.base] == brute_pii(r.text) for r in rows) and len(rows) == len(texts)


SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")


def brute_private(text):
    base = [(k, a, b) for k, a, b in brute_pii(text)]
    secrets = [("secret", m.start(), m.end()) for m in SECRET.finditer(text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return base, [s for s in secrets if not any(a < s[2] and s[1] < b for _, a, b in base)]


def group_of(kind, value):
    digits = re.sub("[^0-9]", "", value)
    named = {"email": ("domain", value.rsplit("@")[-1].lower()), "ip": ("network", ".".join(value.split(".")[:3])), "card": ("issuer", digits[:6]), "phone": ("prefix", digits[:5]), "secret": ("begins", value[:4])}
    return ":".join(named[kind])


def brute_terms(rows, least=pii.LEAST_DOCS):
    """Scores of all pairs over ``(doc_id, text)`` rows by counting, and the spans that they give each row."""
    words = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))
    entity = lambda k, v: f"{k}:" + (re.sub("[^0-9]", "", v) if k in ("card", "phone") else v if k == "secret" else v.lower())
    n_term, n_entity, n_both, own = {}, {}, {}, []
    for _, text in rows:
        text = text or ""
        base, secrets = brute_private(text)
        mine = {entity(k, text[a:b]) for k, a, b in base + secrets} | {f"any {k}" for k, _, _ in base + secrets} | {group_of(k, text[a:b]) for k, a, b in base + secrets}
        own.append(mine)
        out, at = "", 0
        for _, a, b in sorted(base + secrets, key=lambda s: (s[1], s[2], s[0])):
            out, at = (out + text[at:a] + " ", b) if a >= at else (out, max(at, b))
        for w in words(out + text[at:]):
            n_term[w] = n_term.get(w, 0) + 1
        for e in mine:
            n_entity[e] = n_entity.get(e, 0) + 1
            for w in words(out + text[at:]):
                n_both[e, w] = n_both.get((e, w), 0) + 1
    pairs = {p: n for p, n in n_both.items() if n >= least and n_entity[p[0]] >= least}
    enough, found = math.log2(max(1, len(pairs))) + pii.MARGIN, {}
    for (e, w), n in pairs.items():
        information, shared = math.log2(len(rows) / n_entity[e]), math.log2(len(rows) * n / (n_entity[e] * n_term[w]))
        if information > 0 and shared >= pii.GENERALISE * information and n * shared >= enough:
            found[e, w] = "remove" if shared >= pii.REMOVE * information else "generalise"
    spans = []
    for (_, text), mine in zip(rows, own):
        base, secrets = brute_private(text)
        actions = {}
        for (e, w), action in found.items():
            if e in mine:
                actions[w] = max(action, actions.get(w, ""))
        taken = base + secrets
        hits = [(actions[m[0].lower()], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "") if m[0].lower() in actions]
        spans.append(base + sorted([*secrets, *(h for h in hits if not any(a < h[2] and h[1] < b for _, a, b in taken))], key=lambda s: s[1]))
    return found, spans


def planted(rows):
    """Documents with words that give entities away, near and far from them."""
    far, top = "plain words go on and on here " * 30, max(i for i, _ in rows)
    texts = [f"Zorblax {far} lives behind 10.0.0.{i % 5} and 10.0.0.9" for i in range(12)] + [f"mail Quuxley at c@copy.example.com or +1 (555) 010-{1000 + i}" for i in range(9)]
    texts += [f"Mixwell {'10.0.0.9' if i < 3 else ''} {far}" for i in range(12)] + [f"the passwort is {'0123456789abcdef' * 2}{i}" for i in range(10)]
    texts += [f"Domwort writes from u{i}@inside.example.org {far}" for i in range(9)] + [f"Netzwort {far} at 10.77.3.{i}" for i in range(9)]  # groups of values that occur once
    texts += [f"Cardwort {far} paid by 411111{i}" for i in ("0000001375", "0000002746", "0000004114", "0000005483", "0000006853", "0000008222")]
    return [*rows, *((top + 1 + i, t) for i, t in enumerate(texts))]


def test_disclosing_terms_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (docs, planted(docs), planted(docs) * 2):
        want, spans = brute_terms(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        marked = pii.marked(df)
        got = {(r.entity, r.term): r.action for r in pii.disclosing_terms(marked.where("size(private) > 0").select("text", "private"), df).collect()}
        assert got == want
        found = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in [*r.base, *r.terms]]) for r in pii.find_pii(df).collect())
        assert found == sorted((i, s) for (i, _), s in zip(rows, spans))
    flagged = {w for _, w in want}
    assert {"zorblax", "quuxley", "passwort", "domwort", "netzwort", "cardwort"} <= flagged and "mixwell" not in flagged and "plain" not in flagged


def test_sanitised_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t, len(t or ""), "x") for i, t in planted(docs)] + [(900_001, None, 0, "x"), (900_002, "a@b.co " * 20_000, 140_000, "x"), (None, "x@y.zw", 6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(clean) == len(rows) and pii.sanitise(df).columns == df.columns and {r.base for r in clean.values()} == {"x"}
    assert clean[900_001].text is None and clean[900_002].text == "<EMAIL> " * 20_000 and clean[None].text == "<EMAIL>"
    for i, text, n_chars, _ in rows:
        got, spans = clean[i], brute_private(text)
        assert (got.text == text and got.n_chars == n_chars) == (not any(spans)) and (text is None or got.n_chars == len(got.text))
        assert not any(text[a:b] in got.text for part in spans for _, a, b in part)
    last = max(i for i, _ in docs)
    assert clean[last + 1].text.startswith(" plain words") and clean[last + 1].text.endswith("<IP> and <IP>")
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.find_pii(df.limit(0)).count() == 0


def test_url_filter(spark):
    edits = spark.createDataFrame(
        [("spam", "block", "h.example.com", "add", 10), ("spam", "block", "h.example.com", "remove", 20), ("spam", "block", "h.example.com", "remove", 5), ("ok", "allow", "h.example.com/en", "add", 12), ("x", "block", "example.com", "add", 15), ("x", "block", "example.com", "remove", 15), ("y", "block", None, "add", 1), ("z", "block", "h.example.com", "add", 10), ("z", "block", "h.example.com", "add", 10)],
        "list string, effect string, key string, action string, day long",
    )
    rows = [(1, "https://h.example.com/a", 9), (2, "https://h.example.com/a", 10), (3, "http://u@H.example.com:80/en/b?q", 12), (4, "https://h.example.com/a", 20), (5, None, 10), (6, "nonsense", 10), (7, "//h.example.com", None)]
    got = {r.page_id: (r.verdict, r.matched_lists, r.n_active) for r in urlfilter.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetched long"), edits).collect()}
    assert got == {1: ("none", None, 0), 2: ("block", "spam,z", 2), 3: ("allow", "ok", 3), 4: ("block", "z", 1), 5: ("none", None, 0), 6: ("none", None, 0), 7: ("none", None, 0)}
    none = urlfilter.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetched long"), edits.limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"none"}


def test_captures_keep_a_row_each(spark):
    edit = lambda key, list_="l", effect="block": (list_, effect, key, "add", 0)
    edits = spark.createDataFrame([edit("h.example.com/"), edit("a.example.com/p?x=1"), edit("a.example.com/p", "m", "allow"), edit("10.0.0.7"), edit("0.7"), edit("[::1]"), edit("localhost")], "list string, effect string, key string, action string, day long")
    rows = [(1, "http://h.example.com/", 5, 0), (1, "http://h.example.com", 5, 0), (1, "http://h.example.com/x", 5, 0), (1, "http://h.example.com/x", 5, 1), (2, "http://a.example.com/p?x=1#f", 5, 0), (2, "http://a.example.com/p/?x=2", 5, 0),
            (3, "http://9.9.0.7/a", 5, 0), (3, "http://10.0.0.7:8080/a", 5, 0), (4, "http://[::1]:80/", 5, 0), (5, "http://localhost/", 5, 0), (None, "http://h.example.com?", 5, 0)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched long, host int")
    got = sorted((str(r.page_id), r.verdict, str(r.matched_key), r.n_active) for r in urlfilter.filter_captures(captures, edits).collect())
    assert got == sorted([("1", "block", "h.example.com/", 1)] * 2 + [("1", "none", "None", 0)] * 2 + [("2", "block", "a.example.com/p?x=1", 2), ("2", "allow", "a.example.com/p", 1), ("3", "none", "None", 0), ("3", "block", "10.0.0.7", 1), ("4", "block", "[::1]", 1), ("5", "block", "localhost", 1), ("None", "block", "h.example.com/", 1)])
    assert urlfilter.filter_captures(captures.limit(0), edits).count() == 0
