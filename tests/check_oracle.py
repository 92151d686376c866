"""Compares registered queries with their SQL twins: python tests/check_oracle.py [sf] [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(rows):
    def one(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def compare(q, spark, con, folder):
    df = q(spark, folder)
    cols = df.columns
    got = norm(tuple(r) for r in df.collect())
    sql = q.oracle()
    if sql is None:
        return len(got), "rows-only", ""
    cur = con.execute(sql)
    assert [d[0] for d in cur.description] == cols, (cols, cur.description)
    want = norm(cur.fetchall())
    if got == want:
        return len(got), "ok", ""
    extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return len(got), "DIFF", f"got {len(got)} want {len(want)} extra {len(extra)} {extra[:2]} missing {len(missing)} {missing[:2]}"


def main():
    from tideline.plans import CATALOG
    from tideline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = [a for a in sys.argv[2:] if not a.startswith("--")]
    for a in sys.argv[2:]:
        if a.startswith("--chunk="):  # many small chunks, to exercise halos and carries
            from tideline.functions import blocks
            from tideline.operators import hmm

            blocks.CHUNK = hmm.CHUNK = int(a.split("=")[1])
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(folder)
    bad = 0
    for name, q in CATALOG.items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        t = time.time()
        try:
            n, verdict, note = compare(q, spark, con, folder)
        except Exception as e:  # noqa: BLE001
            n, verdict, note = -1, "ERROR", f"{type(e).__name__}: {str(e)[:900]}"
        bad += verdict in ("DIFF", "ERROR")
        if verdict != "ok" or parts or time.time() - t > 8:
            print(f"{name:28s} {verdict:9s} rows={n} {time.time() - t:.1f}s {note}", flush=True)
    print("bad:", bad, flush=True)


if __name__ == "__main__":
    main()
