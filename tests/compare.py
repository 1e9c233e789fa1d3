"""Order-insensitive comparison of result tables."""


def normal(frame):
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind in "fiu":
            out[c] = out[c].astype("float64").map(lambda v: "None" if v != v else f"{v:.8g}")
        else:
            out[c] = out[c].map(lambda v: "None" if v is None else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a, b = normal(a), normal(b)
    assert len(a) == len(b)
    differ = (a.values != b.values).any(axis=1)
    assert not differ.any(), f"{differ.sum()} rows differ\n{a[differ].head()}\n{b[differ].head()}"
