"""Record corpora built from the star-schema tables by SQL, so that any engine can say what they hold.

Each is (path, content). The texts are put together with concat only; no doubles are printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Size of a source from which it is worth dealing out to all cores.
SPREAD_BYTES = 1 << 20


def spread(table: DataFrame) -> DataFrame:
    """The table as it is, or dealt out if its files have fewer splits than there are cores: texts are parsed in the tasks
    that read them, and a file of one row group is one task. Tables of many files are never shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    big = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES
    return table.repartition(cores) if big and table.rdd.getNumPartitions() < cores else table


def _table(spark: SparkSession, sf_dir: str, name: str) -> str:
    spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")).createOrReplaceTempView(f"_src_{name}")
    return f"_src_{name}"


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per order, with frontmatter, two headings and links."""
    t = _table(spark, sf_dir, "orders")
    return spark.sql(rf"""SELECT concat('orders/order-', k, '.md') AS path, concat('---\nid: ', k, '\nstatus: ', s, '\ncents: ', cents,
 CASE WHEN k % 5 = 0 THEN '' ELSE concat('\ndate: ', d) END, '\ncustomer: ', c, '\ntags:\n  - ', lower(s), '\n  - ', pr,
 CASE WHEN k % 4 = 0 THEN '\ndiscount: null' ELSE '' END, '\n---\n# Order ', k, '\n\nFor [[customer-', c, '|the customer]].\n',
 CASE WHEN k % 10 = 0 THEN concat('See [[missing-', k, ']].\n') ELSE '' END, '\n## Notes\n', CASE WHEN k % 3 = 0 THEN '' ELSE concat('\nPlaced on ', d, '.\n') END) AS content
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, cast(round(o_totalprice * 100) AS bigint) AS cents, date_format(o_orderdate, 'yyyy-MM-dd') AS d, lower(replace(o_orderpriority, ' ', '-')) AS pr FROM {t})""")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts as bodies."""
    t = _table(spark, sf_dir, "documents")
    return spark.sql(rf"SELECT concat('docs/', coalesce(lang, 'xx'), '/doc-', doc_id, '.md') AS path, concat('---\nid: ', doc_id, '\nlang: ', coalesce(lang, 'xx'), '\nsource: ', coalesce(source, 'none'), '\nn_chars: ', coalesce(n_chars, 0), '\n---\n', coalesce(text, '')) AS content FROM {t}")


def wrapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with frontmatter in an HTML comment."""
    t = _table(spark, sf_dir, "pages")
    return spark.sql(rf"""SELECT concat('pages/page-', page_id, '.html') AS path, concat('<!--\n---\npage: ', page_id, '\nurl: "', url, '"\n---\n-->\n', coalesce(html, '')) AS content FROM {t}""")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: customers, nations and regions that link to each other; each region has a second file of its name."""
    c, n, r = (_table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    slug = "lower(replace({}, ' ', '-'))"
    return spark.sql(rf"""SELECT concat('customers/customer-', c_custkey, '.md') AS path, concat('---\nsegment: ', c_mktsegment, '\nnation: ', n_name, '\n---\n# ', c_name, '\n\nFrom [[', {slug.format('n_name')}, ']].\n') AS content FROM {c} JOIN {n} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('nations/', {slug.format('n_name')}, '.md'), concat('# ', n_name, '\n\nIn [[', {slug.format('r_name')}, ']], see [[#History]].\n') FROM {n} JOIN {r} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('regions/', {slug.format('r_name')}, '.md'), concat('# ', r_name, '\n') FROM {r}
UNION ALL SELECT concat('archive/', {slug.format('r_name')}, '.md'), concat('# ', r_name, ' (old)\n') FROM {r}""")


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge bundle of parts and suppliers, some of them invalid."""
    p, s = (_table(spark, sf_dir, x) for x in ("part", "supplier"))
    one = rf"""concat(CASE WHEN k % 13 = 0 THEN '' ELSE concat('---\ntitle: ', kind, ' ', k, CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN '\ntype: "  "' ELSE concat('\ntype: ', t) END, CASE WHEN k % 2 = 0 THEN '' ELSE '\ndescription: text' END, '\n---\n') END,
 CASE WHEN k % 5 = 0 THEN '' ELSE concat('About ', kind, ' ', k, '.\n', CASE WHEN k % 3 = 0 THEN '\n# Citations\n\n- one\n' ELSE '' END) END)"""
    return spark.sql(rf"""SELECT concat('parts/part-', k, '.md') AS path, {one} AS content FROM (SELECT p_partkey AS k, 'part' AS kind, p_type AS t FROM {p})
UNION ALL SELECT concat('suppliers/supplier-', k, '.md'), {one} FROM (SELECT s_suppkey AS k, 'supplier' AS kind, 'Supplier' AS t FROM {s})
UNION ALL SELECT 'index.md', '# Index\n' UNION ALL SELECT 'log.md', '# Log\n\n## 2026-01-02\n\nDone.\n\n## Yesterday\n'""")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per event whose properties are a flow mapping."""
    t = _table(spark, sf_dir, "events")
    return spark.sql(rf"SELECT concat('events/event-', event_id, '.md') AS path, concat('---\nid: ', event_id, '\nuser: ', user_id, '\nkind: ', event_type, '\nprops: ', coalesce(props, '{{}}'), '\n---\n') AS content FROM {t}")
