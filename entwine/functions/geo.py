"""Geographic layers of an address as column expressions, and adaptive block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from .text import SPACE, ascii_fold, collapse

#: Chunks that, as a whole, tell no place.
GEO_STOPWORDS = (
    "drive", "dr", "street", "st", "road", "rd", "avenue", "ave", "lane", "ln",
    "boulevard", "blvd", "no", "number", "plot", "flat", "shop", "floor", "building",
    "bldg", "near", "opp", "opposite", "behind", "city", "town", "pradesh", "state",
    "ltd", "inc", "corp", "co", "llc", "room", "suite", "ste", "apt", "apartment",
    "marg", "nagar", "vihar", "puram", "gali", "bhavan", "mahal", "complex",
    "bagh", "chowk", "naka", "taluka", "zila", "mandal", "gram", "phase", "sector",
    "khand", "colony", "enclave", "extension", "ext", "cross", "main",
    "rue", "chemin", "place", "allee", "route", "impasse", "batiment",
    "immeuble", "etage", "cedex", "bp", "boite", "postale",
)
#: Names of the countries themselves.
COUNTRY_NAMES = ("usa", "us", "india", "ind", "france")
#: A postal code stands at the end of an address, or one word before it.
PIN = r"(?U)\b\d{5,6}\b(?=[^\w]*$|\s*[a-z]{2,}\s*$)"
PIN_SUFFIX = r"[0-9]{5,6}$"
#: Distinct combinations of address parts up to which they are broadcast (some 50 MB).
BROADCAST_ROWS = 200_000


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim takes spaces only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def country_key(country: Column) -> Column:
    return F.coalesce(strip(F.lower(country)), F.lit(""))


def pin(address: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(strip(F.lower(address)), F.lit("")), PIN, 0), F.lit(""))


def chunks(address: Column, country: Column) -> Column:
    """Valid comma parts of an address in order: cleaned, more than one character, no stopword, no country.

    All cleaning is done on the whole address with its commas kept, so that no pattern runs part by part; only a letter
    that folds to a comma must not part it.
    """
    whole = F.lower(ascii_fold(F.translate(F.coalesce(F.lower(address), F.lit("")), "‚", " ")))
    plain = F.regexp_replace(whole, r"\b[0-9]{5,6}\b|[^a-z0-9_,\x09-\x0D\x1C-\x20]", " ")
    parts = F.split(collapse(plain), " ?, ?")
    none = (*GEO_STOPWORDS, *COUNTRY_NAMES)
    valid = F.filter(parts, lambda c: (F.length(c) > 1) & ~c.isin(*none) & (c != country_key(country)))
    return F.transform(valid, lambda c: F.replace(c, F.lit(" "), F.lit("_")))


def layers(address: Column, country: Column) -> Column:
    """struct(country, pin, chunk_1, chunk_2): chunk_1 is the last valid part, chunk_2 the one before it."""
    parts = chunks(address, country)
    return F.struct(country_key(country).alias("country"), pin(address).alias("pin"), F.try_element_at(parts, F.lit(-1)).alias("chunk_1"), F.try_element_at(parts, F.lit(-2)).alias("chunk_2"))


def base_key(geo: Column) -> Column:
    """country_pin, else country_chunk1, else country_unknown."""
    return F.concat(geo["country"], F.lit("_"), F.coalesce(geo["pin"], geo["chunk_1"], F.lit("unknown")))


def assign_block_keys(rows: DataFrame, upper: int, lower: int, scope: list[str] = (), first: Column | None = None, among: DataFrame | None = None) -> DataFrame:
    """Add geo_block_key from base_key, geo and clean_name in three passes over key counts inside each scope.

    Keys without a postal code that hold more than `upper` rows become country_chunk2_chunk1 where there is a chunk_2;
    those still above take the first letter of the name; keys below `lower` fold into the country's unknown block.

    A key depends on base key, chunks and first letter alone, so rows are first counted by those (partial sums before
    the shuffle, whatever one key's share of all rows); the passes run on that table of distinct combinations, which is
    written out, and one join brings the keys back. Up to BROADCAST_ROWS combinations are broadcast, so that texts are not
    shuffled. rows is read twice. first: the first letter of the name where it need not be taken from clean_name, so that names
    are not cleaned for the counts. among: all records, with the same columns, where rows are a part of them; keys are those of the whole.
    """
    letter = F.coalesce(F.nullif(F.substring("clean_name", 1, 1) if first is None else first, F.lit("")), F.lit("z"))
    named = {"_base": F.col("base_key"), "_c": F.col("geo")["country"], "_1": F.col("geo")["chunk_1"], "_2": F.col("geo")["chunk_2"], "_letter": letter}
    own, by = rows.withColumns(named), [*scope, *named]
    combos = (own if among is None else among.withColumns(named)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.col("_base"))
    size = F.sum("_n").over(Window.partitionBy(*scope, "_key"))
    massive = (F.col("_rows") > upper) & ~F.col("_key").rlike(PIN_SUFFIX)
    combos = combos.withColumn("_rows", size).withColumn("_key", F.when(massive & F.col("_2").isNotNull(), F.concat_ws("_", "_c", "_2", "_1")).otherwise(F.col("_key")))
    combos = combos.withColumn("_rows", size).withColumn("_key", F.when(massive, F.concat_ws("_", "_key", "_letter")).otherwise(F.col("_key")))
    tiny = F.concat(F.split("_key", "_")[0], F.lit("_unknown"))
    combos = combos.withColumn("_rows", size).withColumn("geo_block_key", F.when(F.col("_rows") < lower, tiny).otherwise(F.col("_key")))
    named = files.written(combos.select(*[F.col(c).alias(f"k{c}") for c in by], "geo_block_key"), "keys")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    same = [F.col(c).eqNullSafe(F.col(f"k{c}")) if c in ("_1", "_2") else F.col(c) == F.col(f"k{c}") for c in by]
    return own.join(named, same).drop(*[f"k{c}" for c in by], *[c for c in by if c not in scope])


def threshold_sweep(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """Block sizes that the first pass would give under several upper thresholds, all in one job.

    rows need geo and base_key. Returns threshold, massive_keys, max_block_size, blocks.
    """
    sizes = rows.groupBy("base_key", "geo").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy("base_key")))
    swept = sizes.withColumn("threshold", F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds])))
    massive = F.col("total") > F.col("threshold")
    geo = F.col("geo")
    finer = F.concat(geo["country"], F.lit("_"), geo["chunk_2"], F.lit("_"), geo["chunk_1"])
    split = massive & ~F.col("base_key").rlike(PIN_SUFFIX) & geo["chunk_2"].isNotNull()
    keyed = swept.select("threshold", "n", F.when(massive, F.col("base_key")).alias("massive"), F.when(split, finer).otherwise(F.col("base_key")).alias("key"))
    big = keyed.where("massive IS NOT NULL").select("threshold", "massive").distinct().groupBy("threshold").agg(F.count(F.lit(1)).alias("massive_keys"))
    blocks = keyed.groupBy("threshold", "key").agg(F.sum("n").alias("size")).groupBy("threshold").agg(F.max("size").alias("max_block_size"), F.count(F.lit(1)).alias("blocks"))
    return blocks.join(big, "threshold", "left").select("threshold", F.coalesce("massive_keys", F.lit(0)).cast("long").alias("massive_keys"), "max_block_size", "blocks")
