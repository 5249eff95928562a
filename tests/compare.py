"""What tests of queries share."""

import math
from collections import Counter

DATA = "/root/testdata/sf0.001"


def same_rows(df, con, sql):
    """Whether a DataFrame and a DuckDB query give the same rows, columns by name."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    theirs = sorted(tuple(show(r[names.index(c)]) for c in order) for r in found.fetchall())
    ours = sorted(tuple(show(r[c]) for c in order) for r in df.collect())
    assert ours == theirs


def fuzzy_cosine(a, b, alike, penalty, least=0.6):
    """The fuzzy score from a to b by its definition, occurrence after occurrence."""
    if not a or not b:
        return 0.0
    fa, fb = ({t: n / len(x) for t, n in Counter(x).items()} for x in (a, b))
    x, y, used = [], [], set()
    for t in a:
        if t in fb:
            j = b.index(t)
        else:
            reach = [(-alike.get((t, u), 0.0), k) for k, u in enumerate(b) if alike.get((t, u), 0.0) >= least]
            j = min(reach)[1] if reach else None
        if j is None:
            x.append(fa[t])
            y.append(0.0)
            continue
        used.add(j)
        w = 1.0 / (1.0 + penalty * math.sqrt(fa[t] * fb[b[j]]))
        x.append(fa[t] * w)
        y.append(fb[b[j]] * w)
    rest = [fb[u] for k, u in enumerate(b) if k not in used]
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y + rest))
    return sum(u * v for u, v in zip(x, y)) / norm if norm else 0.0
