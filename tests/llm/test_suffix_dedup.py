import hashlib

import numpy as np
import pytest

from rastrel.llm import suffix_dedup as S


def brute(rows, length):
    low = lambda r: (-(1 << 63) if r[0] is None else r[0], r[0] is not None, (r[1] or "").encode())
    seen, out = set(), []
    for r in sorted(rows, key=low):
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [2048, 3])
def test_matches_brute_force(spark, docs, corpus, heavy):
    got = S.dedup(spark, docs, block_bytes=5000, shard_bytes=3000, heavy=heavy)
    want = brute(corpus, 100)
    by_key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert by_key(got.collect()) == want
    assert sum(r[2] for r in want) > 1000


def test_empty(spark, empty):
    assert S.dedup(spark, empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, [2, 3, 256, 1, 4, 5][seed], 700).astype(np.uint8)
    raw = data.tobytes()
    sa = S.suffix_array(data)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert sa.tolist() == want
    start = np.array([0, 100, 350])
    lcp = S.common_prefixes(data, sa, start, 100)

    def common(a, b):
        k = 0
        while k < 100 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(want[1:], want, strict=False)]
