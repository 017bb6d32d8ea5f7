"""Stored codes of the embedding join: what is written once, what is recomputed exactly."""

import math

import numpy as np
import pyarrow as pa
import pytest

import rosterlens.llm.binary_codes as module
from rosterlens.llm.binary_codes import (
    _compare,
    _index,
    _reaching,
    differing,
    encode,
    in_bytes,
    most_differing,
    near_vectors,
    pack,
    signs,
)


def indexed(x, tables=1, bits=0):
    n, d = x.shape
    batch = pa.record_batch({
        "id": pa.array(np.arange(n)), "label": pa.array(["1"] * n), "dims": pa.array(np.full(n, d, np.int32)),
        "vector": pa.array(x.tolist(), pa.list_(pa.float64())),
    })
    return pa.Table.from_batches(list(_index(tables, bits)([batch])))


def pairs_near(rng, n, d, low, high):
    """2n unit vectors: each of the first n has a partner at a cosine in [low, high]."""
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((n, d))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(low, high, (n, 1))
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * off])


@pytest.mark.parametrize("d", [1, 7, 64, 65, 200])
def test_codes_pack_and_count(d):
    rng = np.random.default_rng(d)
    code = np.where(rng.standard_normal((30, d)) >= 0, 1.0, -1.0)
    words = pack(code)
    assert words.shape == (30, -(-d // 64)) and (signs(words, d) == code).all()
    assert (differing(words, words) == (code[:, None, :] != code[None, :, :]).sum(axis=2)).all()
    y = rng.standard_normal((30, d))
    small, scale, lost = in_bytes(y)
    assert (np.abs(y - small * scale[:, None]).sum(axis=1) <= lost + 1e-12).all()


@pytest.mark.parametrize("d, threshold", [(4, 0.93), (64, 0.93), (64, 0.5), (256, 0.93)])
def test_bit_limit_is_the_binomial_tail(d, threshold):
    p = math.acos(threshold) / math.pi
    k = most_differing(d, threshold)

    def above(k):
        return sum(math.comb(d, i) * p**i * (1 - p) ** (d - i) for i in range(k + 1, d + 1))

    assert above(k) <= 1e-6 and (k == 0 or above(k - 1) > 1e-6)
    assert most_differing(d, 1.0) == d and most_differing(d, -1.0) == d      # no angle to judge by: nothing is left out


def test_groups_use_stored_codes_and_few_exact_products(monkeypatch):
    """A block of 1,000: no rotation, links as by brute force, exact products near the number of links."""
    x = pairs_near(np.random.default_rng(3), 500, 64, 0.9, 0.99)
    table = indexed(x)
    n = len(x)
    for name, value in {"m": 1, "block": 0, "lo": 0, "hi": 0, "table": 0}.items():
        table = table.append_column(name, pa.array(np.full(n, value)))
    counted = []
    exact = module.exact_products
    monkeypatch.setattr(module, "exact_products", lambda u, p, q: (counted.append(len(p)), exact(u, p, q))[1])
    for name in ("rotation", "encode", "pack", "in_bytes"):
        monkeypatch.setattr(module, name, lambda *_: pytest.fail("codes are made again"))
    got = _compare(0.93)(table)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert dict(zip(got["id"].to_pylist(), got["n"].to_pylist())) == {i: int(c) for i, c in enumerate(want) if c}
    links, met = want.sum() // 2, n * (n - 1) // 2
    print(f"{links} links, {sum(counted)} exact products of {met} pairs that met")
    assert links > 200 and links <= sum(counted) < met / 100


def test_a_wrong_stored_factor_changes_the_result():
    """The bounds are those of the stored columns: with factors far too large nothing reaches the threshold."""
    x = pairs_near(np.random.default_rng(5), 50, 64, 0.95, 0.99)
    table = indexed(x)
    codes = {
        "code": np.array([np.frombuffer(v, np.uint64) for v in table["code"].to_pylist()]),
        "turned": np.array([np.frombuffer(v, np.int8) for v in table["turned"].to_pylist()]),
        **{c: table[c].to_numpy() for c in ("factor", "scale", "lost")},
    }
    p, q = np.arange(50), np.arange(50, 100)
    assert _reaching(codes, p, q, 0.93).all()
    assert not _reaching(codes | {"factor": codes["factor"] * 100}, p, q, 0.93).any()


def test_byte_bounds_hold():
    x = np.random.default_rng(8).standard_normal((300, 64))
    y, code, f = encode(x)
    small, scale, lost = in_bytes(y)
    full = code @ y.T
    rounded = (code @ small.T.astype(float)) * scale
    assert (np.abs(full - rounded) <= lost + 1e-9).all()


def test_ties_and_odd_vectors(spark):
    """Equal, scaled, opposite, one-number and unusable vectors; clashing columns; an empty table."""
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1e-300, 0.0], 0), (4, [-1.0, 0.0], 0), (5, [1e300, 0.0], 0),
            (6, [2.0], 0), (7, [5.0], 0), (8, None, 0), (9, [0.0, 0.0], 0), (10, [float("nan"), 1.0], 0), (11, [1.0, 0.0], None)]
    df = spark.createDataFrame([(*r, "mine", b"x", 1.0) for r in rows],
                               "vec_id long, embedding array<double>, label int, keys string, code binary, factor double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    alone = {i: (0, i, True) for i in (4, 8, 9, 10, 11)}
    assert got == alone | {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 5: (3, 1, False), 6: (1, 6, True), 7: (1, 6, False)}
