"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidegate.plans import registry
from tidegate.plans.tables import PREDICTIONS

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6g}" if v else "0"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def test_flagship_and_names():
    assert registry.FLAGSHIP in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(name, spark, duck):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name, cut", [("jn02_backward_as_of", " WHERE o_orderkey % 7 = 0"), ("jn03_covering", " WHERE o_orderkey % 7 = 0"), ("jn04_chained_start", " WHERE o_orderkey % 7 = 0"), ("jn24_membership", " AND o_orderkey % 5 = 0")])
def test_query_covers_every_order(name, cut, spark, duck):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name].replace(cut, "")).df()
    assert rows(got) == rows(want)
    if name != "jn24_membership":
        assert set(got["point_id"]) == set(duck.execute("SELECT o_orderkey FROM orders").df()["o_orderkey"]) and got["point_id"].is_unique


def test_bootstrap_has_all_replicates(spark, duck):
    got = registry.queries()["mt04_bootstrap"](spark, DATA).toPandas().sort_values("rep")
    assert list(got["rep"]) == list(range(2000))
    want = duck.execute(registry.oracle_sql()["mt04_bootstrap"]).df()
    assert rows(got[got["rep"] < len(want)]) == rows(want)
    told = registry.queries()["mt06_interval"](spark, DATA).toPandas().iloc[0]
    low, high = np.quantile(got["mean"] - 0.8, [0.025, 0.975])
    assert abs(told["low"] - low) < 1e-5 and abs(told["high"] - high) < 1e-5
    assert abs(told["p"] - (1 + sum(got["mean"] >= 0.8)) / 2001) < 2e-3


MODES = """, x AS (SELECT site, entity, y - 0.8::double AS v FROM pr WHERE y IS NOT NULL AND label = 'quality' AND site IS NOT NULL),
  n AS (SELECT site, v, row_number() OVER (PARTITION BY site ORDER BY entity) - 1 AS row, count(*) OVER (PARTITION BY site) AS n FROM x),
  t AS (SELECT site, sum(v) AS total, count(*) AS n, row_number() OVER (ORDER BY site) - 1 AS number, count(*) OVER () AS k FROM x GROUP BY 1),
  p AS (SELECT rep, t.number AS pos, ('0x' || substr(md5(concat_ws('|', '7', rep, 'site', t.number)), 1, 8))::bigint % k AS number FROM t, range(2000) r(rep)),
  w AS (SELECT site, rep, ('0x' || substr(md5(concat_ws('|', '7', rep, site, row)), 1, 8))::bigint % n AS row FROM n, range(2000) r(rep)),
  b AS (SELECT n.site, rep, ('0x' || substr(md5(concat_ws('|', '7', rep, pos, n.site, row)), 1, 8))::bigint % n.n AS row FROM p JOIN t USING (number) JOIN n ON n.site = t.site),
  m AS (SELECT 'within_site' AS mode, rep, avg(v) AS mean FROM w JOIN n USING (site, row) GROUP BY 2 UNION ALL SELECT 'cluster', rep, sum(total) / sum(n) FROM p JOIN t USING (number) GROUP BY 2
    UNION ALL SELECT 'two_stage', rep, avg(v) FROM b JOIN n USING (site, row) GROUP BY 2)
  SELECT mode, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high,
    round((count(*) FILTER (mean >= 1e-12) + 1) / (count(*) + 1), 6) AS p_least, round((count(*) FILTER (mean >= -1e-12) + 1) / (count(*) + 1), 6) AS p_most FROM m GROUP BY 1"""


def test_modes_equal_sql_and_join_labels_once(spark, duck):
    got = registry.queries()["mt04_modes"](spark, DATA)
    # what is drawn from was joined, numbered and written once: neither documents nor labels are read, joined or broadcast for each mode
    assert {f.rsplit("/", 2)[-2].split("-")[0] for f in got.inputFiles()} == {"numbered"}
    got, want = got.toPandas().sort_values("mode", ignore_index=True), duck.execute("WITH " + PREDICTIONS + MODES + " ORDER BY mode").df()
    assert rows(got[["mode", "low", "high"]]) == rows(want[["mode", "low", "high"]])
    # a mean of zero but for rounding may count or not
    assert got["p"].between(want["p_least"], want["p_most"]).all()


def test_negation_beside_accents_as_in_sql(spark, duck, tmp_path):
    texts = ["la no\u00edtaga", "la \u00f1no", "la s\u00edn", "la no", "la nota", "la no_", "la ciónno la", "NO la", "la", None]
    said = pd.DataFrame({"conv_id": range(len(texts)), "turn": [1] * len(texts), "role": ["user"] * len(texts), "text": texts})
    said.to_parquet(tmp_path / "conversations.parquet", index=False)
    for t in ("orders", "lineitem", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("ev11_wordings", "ev03_history"):
        assert rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())
