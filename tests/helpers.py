"""What tests share."""

DATA = "/root/testdata"


def plain(x):
    """Values of rows, comparable across engines."""
    if x is None or x != x:
        return None
    if isinstance(x, (bool, str, bytes)):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    b = sorted(repr([plain(r[i]) for i in at]) for r in theirs.fetchall())
    assert len(a) == len(b)
    assert a == b
