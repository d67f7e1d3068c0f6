"""The queries over all rows of the smallest tables, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables():
    read = lambda name: duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()
    return {name: read(name) for name in ("documents", "pages", "embeddings", "benchmark", "labels")}


def rows(spark, name):
    from tidelog.llm.queries import QUERIES

    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_html(spark, tables):
    import html
    import re

    got = {r["page_id"]: r for r in rows(spark, "op1_html_text")}
    for page_id, url, page in tables["pages"]:
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", page)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page_id]["text"], got[page_id]["n_chars"], got[page_id]["url"]) == (want, len(want), url)


def test_warc(spark, tables):
    got = {r["page_id"]: r for r in rows(spark, "op2_warc")}
    holder = {}
    for page_id, _, page in tables["pages"]:
        holder[page] = max(page_id, holder.get(page, page_id))
    for page_id, _, page in tables["pages"]:
        data = page.encode()
        revisit = len(data) >= 1000 and holder[page] != page_id
        assert got[page_id] == {"page_id": page_id, "payload_bytes": len(data), "payload_digest": hashlib.sha1(data).hexdigest(), "record_type": "revisit" if revisit else "response", "refers_to": holder[page] if revisit else None}


def test_decontamination(spark, tables):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [(i, words(t)) for i, t in tables["benchmark"]]
    want = set()
    for doc_id, text, *_ in tables["documents"]:
        joined = " " + " ".join(words(text)) + " "
        want |= {(doc_id, i) for i, w in items if w and " " + " ".join(w) + " " in joined}
    assert {(r["doc_id"], r["item_id"]) for r in rows(spark, "op3_decontamination")} == want and want


def test_byte_bpe(spark, tables):
    import public_tokenizers
    import tiktoken

    from tidelog.llm.bpe import load_ranks

    tokens = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r["doc_id"]: r for r in rows(spark, "op4_byte_bpe")}
    for doc_id, text, *_ in tables["documents"]:
        ids = np.array(plain.encode_ordinary(text), "<u4")
        assert got[doc_id] == {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}


def test_embeddings(spark, tables):
    vectors = {v: (np.array(e, float), label) for v, e, label in tables["embeddings"]}
    pairs = []
    ids = sorted(vectors)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            (x, lx), (y, ly) = vectors[a], vectors[b]
            if lx == ly and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                pairs.append((a, b))
    degree, component = Counter(x for p in pairs for x in p), classes(ids, pairs)
    got = {r["vec_id"]: r for r in rows(spark, "op5_embedding_dedup")}
    assert got == {v: {"vec_id": v, "n_links": degree[v], "component_id": component[v], "kept": component[v] == v} for v in ids}


def test_token_files(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(rows(spark, "op6_token_files"), key=lambda r: r["doc_id"])
    start = 0
    for r, (doc_id, text, *_) in zip(got, sorted(tables["documents"]), strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert r == {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def plain_ppm(training, texts, order=5):
    """log10 probability of each text by the textbook recursion: every byte in its contexts of order down to 0, with exclusion."""
    spell = lambda t: b"\n" * order + b" ".join(t.encode().lower().split()) + b"\n"
    nodes = defaultdict(Counter)
    for s in map(spell, training):
        for i in range(order, len(s)):
            for k in range(order + 1):
                nodes[s[i - k : i]][s[i]] += 1
    memo = {}

    def price(context, symbol):
        ruled, out = set(), 0.0
        for k in range(order, -1, -1):
            node = nodes.get(context[order - k :])
            if not node:
                continue
            left = {x: c for x, c in node.items() if x not in ruled}
            total, fresh = sum(left.values()), len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / (total + fresh))
            out += math.log10(fresh / (total + fresh)) if fresh else 0
            ruled |= node.keys()
        return out - math.log10(256 - len(ruled))

    scores = []
    for s in map(spell, texts):
        total = 0.0
        for i in range(order, len(s)):
            gram = s[i - order : i + 1]
            if gram not in memo:
                memo[gram] = price(gram[:-1], gram[-1])
            total += memo[gram]
        scores.append(total)
    return scores


def test_ppm(spark, tables):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [*t.encode().lower().split(), b"\n"]
    docs = [r[:2] for r in tables["documents"]]
    counts = Counter(w for d, t in docs if not held(d) for w in words(t))
    total = sum(counts.values())
    scores = plain_ppm([t for d, t in docs if not held(d)], [t for _, t in docs])
    got = {r["doc_id"]: r for r in rows(spark, "op7_ppm")}
    for (doc_id, text), score in zip(docs, scores):
        r, w = got[doc_id], words(text)
        want = sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(doc_id), len(w), sum(x in counts for x in w), total)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_secrets(spark, tables):
    import re

    kinds = [
        ("assign", re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    got = {r["doc_id"]: r for r in rows(spark, "op8_secrets")}
    for doc_id, text, *_ in tables["documents"]:
        found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(kinds) for m in p.finditer(text) if good(m)]
        listed = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in sorted(found))
        n = Counter(k for _, k, _ in found)
        r = got[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n[0], n[1], n[2], hashlib.sha256(listed.encode()).hexdigest())


def test_quality(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op9_quality")}
    assert len(got) == len(tables["documents"]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    right = [got[d]["predicted"] == q for d, q, _ in tables["labels"] if got[d]["held_out"]]
    assert np.mean(right) >= 0.85


def near_duplicates(documents, size):
    sets = {}
    for doc_id, text, *_ in documents:
        w = text.encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    holders = defaultdict(list)
    for doc_id, s in sets.items():
        for x in s:
            holders[x].append(doc_id)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[:i])
    pairs = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, classes(sets, pairs)


def test_minhash(spark, tables):
    sets, component = near_duplicates(tables["documents"], 4)
    got = {r["doc_id"]: r for r in rows(spark, "op10_minhash")}
    assert got == {d: {"doc_id": d, "n_shingles": len(s), "component_id": component[d], "kept": component[d] == d} for d, s in sets.items()}


def test_pipeline(spark, tables):
    """Each stage does its part: against the plain versions, on what the stage before kept."""
    import re

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept[name] = [tuple(r) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality = {d: q for d, q, _ in tables["labels"]}
    left = {r[0] for r in kept["quality"]}
    assert np.mean([d in left for d, q in quality.items() if q]) >= 0.95 and np.mean([d in left for d, q in quality.items() if not q]) <= 0.3
    _, component = near_duplicates(kept["quality"], 5)
    assert {r[0] for r in kept["near_dups"]} == {d for d, c in component.items() if d == c}
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(t) for _, t in tables["benchmark"] if len(words(t).split()) >= 5]
    assert {r[0] for r in kept["benchmark"]} == {r[0] for r in kept["near_dups"] if not any(i in words(r[1]) for i in items)}
    before = {r[0]: r for r in kept["benchmark"]}
    assert {r[0] for r in kept["secrets"]} == set(before)
    for r in kept["secrets"]:
        assert not re.search(r"[0-9a-f]{24,}|(?i:token)\s*=\s*\"", r[1])
        assert r == before[r[0]] or (r[1] != before[r[0]][1] and r[4] == len(r[1]))
    out = cp.run(spark, SF).collect()
    texts = {r[0]: r[1] for r in kept["secrets"]}
    assert {r["doc_id"]: r["decoded_sha256"] for r in out} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
