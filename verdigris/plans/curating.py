"""Queries that validate, classify, sample and unite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import first_known_part, label_from_folders, name, path_order, split_role
from ..functions.values import bucket3, scaled_side
from ..operators import curation, sampling, validate
from .registry import query, table
from .views import PRED, SALES, predictions, sales

_ITEMS = """items AS (
  SELECT p_partkey AS image_id, 'root/' || p_brand || '/' || p_partkey || '.JPEG' AS path, p_partkey % 3 - 0 AS label, CASE p_partkey % 5 WHEN 0 THEN 'real' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_brand END AS generator,
         CASE p_partkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'val' ELSE 'train' END AS split, p_size - 2 AS width, 10 AS height,
         CASE p_partkey % 11 WHEN 0 THEN 'gan' WHEN 1 THEN 'vae' END AS family, CASE p_partkey % 13 WHEN 0 THEN 'dit' WHEN 1 THEN 'rnn' END AS arch,
         CASE p_partkey % 17 WHEN 0 THEN 't2i' END AS generation_type, CASE p_partkey % 19 WHEN 0 THEN 'real' WHEN 1 THEN 'partial_manipulation' END AS content_type,
         CASE p_partkey % 4 WHEN 0 THEN '.JPEG' WHEN 1 THEN 'tiff' WHEN 2 THEN ' png ' END AS original_format, CASE p_partkey % 6 WHEN 0 THEN 'xyz' WHEN 1 THEN substr(md5(p_partkey::VARCHAR), 1, 16) END AS phash
  FROM part)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda m, **v: [F.when(k % m == int(n[1:]), x) for n, x in v.items()]
    some = lambda m, **v: F.coalesce(*pick(m, **v))
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"), F.concat(F.lit("root/"), "p_brand", F.lit("/"), k.cast("string"), F.lit(".JPEG")).alias("path"), (k % 3).cast("int").alias("label"),
        F.when(k % 5 == 0, "real").when(k % 5 == 1, "").when(k % 5 == 2, F.lit(None)).otherwise(F.col("p_brand")).alias("generator"),
        F.when(k % 7 == 0, "other").when(k % 7 == 1, "val").otherwise("train").alias("split"), (F.col("p_size") - 2).alias("width"), F.lit(10).alias("height"),
        some(11, _0="gan", _1="vae").alias("family"), some(13, _0="dit", _1="rnn").alias("arch"), some(17, _0="t2i").alias("generation_type"),
        some(19, _0="real", _1="partial_manipulation").alias("content_type"), some(4, _0=".JPEG", _1="tiff", _2=" png ").alias("original_format"),
        F.when(k % 6 == 0, "xyz").when(k % 6 == 1, F.substring(F.md5(k.cast("string")), 1, 16)).alias("phash"),
    )


_NORMAL = f"""WITH {_ITEMS}, z AS (
  SELECT * REPLACE (nullif(nullif(generator, ''), 'real') AS generator, coalesce(content_type, CASE WHEN label = 0 THEN 'real' ELSE 'full_synthetic' END) AS content_type,
                    CASE lower(trim(ltrim(trim(original_format), '.'))) WHEN 'jpeg' THEN 'jpg' WHEN 'tiff' THEN 'tif' WHEN '' THEN NULL ELSE lower(ltrim(trim(original_format), '.')) END AS original_format) FROM items)"""


@query(f"{_NORMAL} SELECT image_id, generator, content_type, original_format FROM z")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return validate.normalized(_items(spark, sf_dir)).select("image_id", "generator", "content_type", "original_format")


@query(
    f"""{_NORMAL}, v AS (SELECT image_id, (label NOT IN (0, 1))::INT + (split NOT IN ('train','val','test','unseen'))::INT + (width < 1)::INT + (label = 0 AND generator IS NOT NULL)::INT
  + coalesce(family NOT IN ('gan','diffusion'), FALSE)::INT + coalesce(arch NOT IN ('unet','dit','flow','pixel'), FALSE)::INT
  + (label = 0 AND coalesce(family, arch, generation_type) IS NOT NULL)::INT + (label = 0 AND content_type <> 'real')::INT + (label = 1 AND content_type = 'real')::INT
  + coalesce(label = 1 AND family = 'gan' AND arch IS NOT NULL, FALSE)::INT + coalesce(NOT regexp_full_match(phash, '[0-9a-fA-F]{{16}}'), FALSE)::INT AS n_violations FROM z)
SELECT image_id, n_violations FROM v"""
)
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many domain rules each row breaks."""
    rows = validate.normalized(_items(spark, sf_dir))
    return rows.select("image_id", F.size(validate.violations(rows)).alias("n_violations"))


@query(f"{_NORMAL} SELECT image_id FROM z WHERE split = 'train' AND content_type IS DISTINCT FROM 'partial_manipulation'")
def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return validate.trainable(validate.normalized(_items(spark, sf_dir))).select("image_id")


@query(
    """WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '{"image_id":"a","label":1}' WHEN 1 THEN '{"image_id":"a","label":true}' WHEN 2 THEN '{"image_id":"a","label":1.0}'
  WHEN 3 THEN '{"image_id":"a","label":1,"odd":2}' WHEN 4 THEN '{"image_id":"a"}' ELSE '[1]' END AS value FROM part)
SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'label: BIGINT expected' WHEN 2 THEN 'label: BIGINT expected' WHEN 3 THEN 'unknown fields odd' WHEN 4 THEN 'missing fields label' ELSE 'not an object' END AS errors FROM l"""
)
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw types, unknown and missing fields of JSON lines."""
    from ..schema import struct

    texts = ['{"image_id":"a","label":1}', '{"image_id":"a","label":true}', '{"image_id":"a","label":1.0}', '{"image_id":"a","label":1,"odd":2}', '{"image_id":"a"}', "[1]"]
    value = F.array(*[F.lit(t) for t in texts])[(F.col("p_partkey") % 6).cast("int")]
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), value.alias("value"))
    small = struct("image_id string, label int")
    rows = validate.parse_strict(lines, small, ["image_id", "label"])
    return rows.select("id", F.array_join("errors", "; ").alias("errors"))


_SPEC = {"label": 1, "generator": ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"], "exclude_content_type": ["partial_manipulation"]}


@query(f"{_NORMAL} SELECT image_id FROM z WHERE label = 1 AND generator IN {tuple(_SPEC['generator'])} AND content_type IS DISTINCT FROM 'partial_manipulation'")
def pool_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return sampling.matching(validate.normalized(_items(spark, sf_dir)), _SPEC).select("image_id")


@query(f"WITH {PRED} SELECT doc_id FROM pred WHERE label = 0 OR generator IN ('src1', 'src2')")
def generator_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positives of some generators, all negatives."""
    return sampling.among_generators(predictions(spark, sf_dir), ["src1", "src2"], label="label").select("doc_id")


_RULES = [
    {"pattern": "brand#1[12]/", "generator": "alpha", "family": "gan", "label": 1},
    {"pattern": "brand#2", "generator": "beta", "family": "diffusion", "arch": "unet", "generation_type": "t2i", "label": 1},
    {"pattern": "brand#[13]", "label": 0},
]
_SCAN = """WITH f AS (SELECT 'x/' || p_brand || '/' || p_partkey || '.jpg' AS rel, p_size AS width, 20 AS height FROM part),
r AS (SELECT *, CASE WHEN regexp_matches(rel, '(?i)brand#1[12]/') THEN 0 WHEN regexp_matches(rel, '(?i)brand#2') THEN 1 WHEN regexp_matches(rel, '(?i)brand#[13]') THEN 2 END AS rule FROM f WHERE NOT regexp_matches(rel, '7\\.jpg$'))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.lit("x/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "part").select(rel.alias("rel"), F.col("p_size").alias("width"), F.lit(20).alias("height"))


@query(f"""{_SCAN} SELECT rel, rule, CASE rule WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS generator, CASE rule WHEN 0 THEN 'gan' WHEN 1 THEN 'diffusion' END AS family,
  CASE rule WHEN 1 THEN 'unet' END AS arch, CASE WHEN rule = 2 THEN 0 WHEN rule < 2 THEN 1 END AS label, CASE WHEN rule = 2 THEN 'real' ELSE 'full_synthetic' END AS content_type FROM r""")
def rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first rule that matches, behind exclusions."""
    return curation.classified(_files(spark, sf_dir), _RULES, [r"7\.jpg$"]).select("rel", "rule", "generator", "family", "arch", "label", "content_type")


@query(
    f"""{_SCAN}, g AS (SELECT *, CASE rule WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'real' END AS "group" FROM r WHERE rule IS NOT NULL AND rule <> 1 AND least(width, height) >= 10)
SELECT rel, "group", width FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY string_split(rel, '/')) AS n FROM g) WHERE n <= 15"""
)
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, generator choice, least side, then a cap in path order."""
    rows = curation.scanned(_files(spark, sf_dir), _RULES, [r"7\.jpg$"], generators=["alpha"], min_side=10, cap=15)
    return rows.select("rel", "group", "width")


@query(f"""{_SCAN} SELECT CASE WHEN rule IS NULL THEN 'unmatched' WHEN rule = 0 THEN 'alpha' WHEN rule = 1 THEN 'beta' ELSE 'real' END AS "group", count(*) AS n FROM r GROUP BY 1""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by class."""
    return curation.scan_report(_files(spark, sf_dir), _RULES, [r"7\.jpg$"])


@query(
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'old') THEN NULL WHEN contains(lower(p_name), '1') THEN 'one' WHEN contains(lower(p_name), '2') THEN 'two' ELSE 'none' END AS class FROM part"""
)
def substring_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    low = F.lower("p_name")
    kind = F.when(low.contains("old"), F.lit(None)).when(low.contains("1"), "one").when(low.contains("2"), "two").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("class"))


@query(
    f"""WITH {PRED}, p AS (SELECT doc_id, list_filter(string_split(image_path, '/'), lambda x: x <> '') AS l FROM pred)
SELECT doc_id, CASE WHEN list_contains(l, 'src1') THEN 'src1' WHEN list_contains(l, 'src2') THEN 'src2' WHEN list_contains(l, 'fake') THEN 'generated' WHEN list_contains(l, 'real') THEN 'real' ELSE 'unknown' END AS generator,
       CASE WHEN list_contains(l, 'fake') THEN 1 WHEN list_contains(l, 'real') THEN 0 END AS y, l[-1] AS name FROM p"""
)
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator, label and name from a path's parts."""
    path = F.col("image_path")
    generator = first_known_part(path, ["src2", "src1"], [("fake", "generated"), ("real", "real")])
    return predictions(spark, sf_dir).select("doc_id", generator.alias("generator"), label_from_folders(path).alias("y"), name(path).alias("name"))


@query(
    """WITH n AS (SELECT p_partkey, p_partkey || ['', '_nano', '_nano_banana', '_gem'][p_partkey % 4 + 1] AS stem FROM part)
SELECT p_partkey, p_partkey::VARCHAR AS source_id, nullif(ltrim(substr(stem, length(p_partkey::VARCHAR) + 1), '_'), '') AS role FROM n"""
)
def role_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source id and role from a name, the longest role first."""
    key = F.col("p_partkey").cast("string")
    ends = F.array(*[F.lit(x) for x in ("", "_nano", "_nano_banana", "_gem")])
    source, role = split_role(F.concat(key, ends[(F.col("p_partkey") % 4).cast("int")]), ["nano", "nano_banana", "gem"])
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source_id"), role.alias("role"))


@query("SELECT doc_id, CASE WHEN n_chars < 800 THEN 'small' WHEN n_chars > 3000 THEN 'large' ELSE 'medium' END AS bucket FROM documents")
def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    return table(spark, sf_dir, "documents").select("doc_id", bucket3(F.col("n_chars"), 800, 3000, ("small", "medium", "large")).alias("bucket"))


@query(
    """SELECT doc_id, greatest(1, round_even(n_chars * 0.8::DOUBLE, 0)::INT) AS cropped, sha1('p' || doc_id || ':' || n_chars) AS image_id FROM documents"""
)
def expected_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after a crop, and content ids."""
    ident = F.sha1(F.concat_ws(":", F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("n_chars").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", scaled_side(F.col("n_chars"), 0.8).alias("cropped"), ident.alias("image_id"))


@query(f"WITH {PRED} SELECT doc_id, label, CASE WHEN label = 0 THEN 'real' ELSE generator END AS generator FROM pred")
def prepared_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from y or label, generator defaults."""
    rows = predictions(spark, sf_dir)
    rows = rows.withColumn("y", F.when(F.col("doc_id") % 2 == 0, F.col("label"))).withColumn("generator", F.when(F.col("label") == 0, "").otherwise(F.col("generator")))
    return curation.prepared(rows).select("doc_id", F.col("label").cast("int").alias("label"), "generator")


def _ranked(what: str, keys: str, seed: str, ident: str, n: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER ({f'PARTITION BY {keys} ' if keys else ''}ORDER BY sha1('{seed}|' || {ident}), {ident}) AS k FROM {what}) WHERE k <= {n}"


@query(f"WITH {PRED} SELECT doc_id, label FROM ({_ranked('pred', 'label', '7', 'doc_id', 30)})")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 rows of either label."""
    return sampling.balanced(predictions(spark, sf_dir), 60, 7, "doc_id", "label").select("doc_id", "label")


@query(f"WITH {PRED} SELECT doc_id, generator FROM ({_ranked('(SELECT * FROM pred WHERE label = 1)', 'generator', '7', 'doc_id', 3)}) UNION ALL SELECT doc_id, generator FROM pred WHERE label = 0")
def capped_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three positives a generator, all negatives."""
    return sampling.capped_positives(predictions(spark, sf_dir), "generator", 3, 7, "doc_id", "label").select("doc_id", "generator")


@query(f"WITH {SALES} SELECT image_path, label FROM ({_ranked('sales', 'label', '7', 'image_path', 10_000)})")
def balanced_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 of many rows: 10,000 of either label, by the digest of the n-th."""
    return sampling.balanced(sales(spark, sf_dir), 20_000, 7, "image_path", "label").select("image_path", "label")


@query(f"WITH {SALES} SELECT image_path, generator FROM ({_ranked('(SELECT * FROM sales WHERE label = 1)', 'generator', '7', 'image_path', 2_000)}) UNION ALL SELECT image_path, generator FROM sales WHERE label = 0")
def capped_generators_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9 of many rows: 2,000 positives a generator, all negatives."""
    return sampling.capped_positives(sales(spark, sf_dir), "generator", 2_000, 7, "image_path", "label").select("image_path", "generator")


@query(f"WITH {SALES} SELECT image_path, label FROM (SELECT * FROM ({_ranked('(SELECT * FROM sales WHERE label = 1)', '', '5/pos', 'image_path', 5_000)}) UNION ALL SELECT * FROM ({_ranked('(SELECT * FROM sales WHERE label = 0)', '', '5/neg', 'image_path', 8_000)}))")
def pool_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10, L11 of many rows: samples of two pools."""
    return sampling.pools(sales(spark, sf_dir), {"pos": {"label": 1, "n": 5_000}, "neg": {"label": 0, "n": 8_000}}, 5, "image_path").select("image_path", "label")


@query(f"WITH {PRED} SELECT doc_id FROM ({_ranked('pred', '', '3', 'doc_id', 50)})")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 seeded rows."""
    return sampling.taken(predictions(spark, sf_dir), 50, 3, "doc_id").select("doc_id")


@query(
    f"""WITH {PRED} SELECT doc_id, 'pos' AS pool FROM ({_ranked("(SELECT * FROM pred WHERE label = 1 AND generator IN ('src1','src2','src3'))", '', '5/pos', 'doc_id', 10)})
UNION ALL SELECT doc_id, 'neg' FROM ({_ranked('(SELECT * FROM pred WHERE label = 0)', '', '5/neg', 'doc_id', 10)})"""
)
def pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two pools."""
    rows = predictions(spark, sf_dir).withColumn("content_type", F.lit("full_synthetic"))
    specs = {"pos": {"label": 1, "generator": ["src1", "src2", "src3"], "n": 10}, "neg": {"label": 0, "n": 10}}
    return sampling.pools(rows, specs, 5, "doc_id").select("doc_id", "pool")


@query(
    f"""WITH {PRED}, b AS (SELECT * FROM pred WHERE condition <> 'fr'), x AS (SELECT * FROM pred WHERE condition = 'fr' AND generator IN ('src1', 'src2'))
SELECT doc_id, label FROM (SELECT *, row_number() OVER (ORDER BY sha1('9|' || doc_id), doc_id) AS k FROM b WHERE label = 1) WHERE k > (SELECT count(*) FROM x WHERE label = 1)
UNION ALL SELECT doc_id, label FROM b WHERE label = 0 UNION ALL SELECT doc_id, label FROM x"""
)
def replaced_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra positives take the place of as many others."""
    rows = predictions(spark, sf_dir).select("doc_id", "label", "condition", "generator")
    extra = rows.where("condition = 'fr' AND generator IN ('src1', 'src2')")
    return sampling.replaced(rows.where("condition <> 'fr'"), extra, 9, "doc_id", "label").select("doc_id", "label")


@query(
    """WITH u AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 40) AS name, 0 AS src FROM customer UNION ALL SELECT s_suppkey, 'building' || (s_suppkey % 60), 1 FROM supplier)
SELECT id, name, src FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY src, id) AS k FROM u) WHERE k = 1"""
)
def dedup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each lower-cased name, by source, then id."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("name"), F.lit(0).alias("src"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("building"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.lit(1).alias("src"))
    return sampling.united([a, b], F.col("name"), F.col("id"))


@query(
    """SELECT c_custkey AS id, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 0) AND s_suppkey NOT IN (SELECT c_custkey FROM customer)"""
)
def union_without_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: a union that adds only new keys."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"))
    return sampling.added(a, b, "id")


@query("SELECT c_custkey AS id, 1 AS y FROM customer UNION ALL SELECT s_suppkey, 0 FROM supplier")
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives with their labels."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return sampling.labelled_union(a, b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a supplier in debt."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def whole_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6 over whole tables: customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(urgent.select("o_custkey"))


@query(f"WITH {PRED} SELECT generator, condition, count(*) AS n FROM pred GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each group, with a least number."""
    return sampling.counted(predictions(spark, sf_dir), ["generator", "condition"], {"src1": 1})


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE k <= 25")
def ordered_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of an ordered scan, pruned to its columns."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(25)


@query("SELECT rel, row_number() OVER (ORDER BY string_split(rel, '/')) AS place FROM (SELECT DISTINCT source || '/' || lang || '-x' AS rel FROM documents UNION SELECT DISTINCT source || '-' || lang FROM documents)")
def path_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the order of their parts."""
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat("source", F.lit("/"), "lang", F.lit("-x")).alias("rel")).union(d.select(F.concat("source", F.lit("-"), "lang"))).distinct()
    return rows.select("rel", F.row_number().over(W.orderBy(path_order(F.col("rel")))).cast("long").alias("place"))

