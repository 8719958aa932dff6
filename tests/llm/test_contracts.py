"""The digest columns of whole-table queries against plain versions on the smallest tables."""

import hashlib
import re
import zlib

import pyarrow.parquet as pq
import pytest
import xxhash

from lexiforge.llm import media, mixing, pii, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op5(spark, sf, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op5_simhash(spark, sf).collect()}
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    least = {i: i for i in prints}
    changed = True
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    assert got == {i: (f"{f:016x}", least[i]) for i, f in prints.items()}


def test_op9(spark, sf, docs):
    got = {r["doc_id"]: r for r in media.op9_media(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want = len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want
        made = r["media_bytes"], r["media_sha256"], r["feature"]
        assert by_text.setdefault(d["text"] or "", made) == made and r["media_bytes"] > 0


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in doubled) % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def test_op10(spark, sf, docs):
    got = {r["doc_id"]: r for r in pii.op10_pii(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p, fits) in enumerate(BASE) for m in re.finditer(p, d["text"] or "") if fits(m[0])]
        listed, r = [s for _, _, s in sorted(found)], got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in BASE] == [sum(s.startswith(k + ":") for s in listed) for k, _, _ in BASE]
        assert set(listed) <= set(r["spans"].split(","))


def test_op1(spark, sf, docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    sums = {}
    for d in docs:
        sums[d["source"]] = sums.get(d["source"], 0) + size[d["doc_id"]]
    names = sorted((s for s in sums if s is not None)) + [s for s in sums if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    targets, open_, left = {}, set(names), 1.5 * sum(sums.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sums[s]}
        if not over:
            targets |= share
            break
        for s in over:
            targets[s], left = 2.0 * sums[s], left - 2 * sums[s]
        open_ -= over
    rows = mixing.op1_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    source, taken = {d["doc_id"]: d["source"] for d in docs}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[s]) and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(0.02 * targets[s], 2 * max(size.values())) for s in names)
