"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts are cut at white space. Each word becomes its template: numbers (in digits or words), numbers with a unit, units after a
number, and names (capitalised words inside a sentence) become typed placeholders; other words lose signs at their ends and
capitals. Windows of templates of the benchmark and of the documents are joined by hash. A window that shares a hash shows
which value stands in each slot on either side.

Slot consistency is put to the vote along one alignment of a document with an item: for each value of the item the value that
stands for it most often in the document is its new value, and a window counts if each of its slots holds the new value. So a
question told anew with other names and numbers is found, even if two old values happen to become the same, while chance
meetings of placeholders, where one value becomes many, are not. An item is in a document if the windows that count cover
enough of its words.

Words are hashed once; windows are hashed while they are exploded, in the stage of the scan, and only those that meet the
benchmark leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut

WINDOW, LITERALS, SHARE = 8, 4, 0.5
#: Words of an item along one alignment that count as a leak whatever their share of the item.
RUN = 25
#: Windows of a benchmark up to which they are broadcast; more are joined in a shuffle.
BROADCAST_WINDOWS = 300_000
# Units of measure and currencies.
UNITS = "mm cm m km mi ft in g kg mg lb oz t l ml gal s sec min h hr hrs ms °c °f k w kw kwh v a hz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents percent % € $ £ meter meters metre metres minute minutes hour hours second seconds day days week weeks month months year years mile miles foot feet inch inches gram grams liter liters litre litres".split()
# Numbers in words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
NUMBER, QUANTITY, UNIT, NAME = "\u0001num", "\u0001qty", "\u0001unit", "\u0001name"
_NUMBER = r"^[-+]?[$€£]?[0-9]+([.,:/][0-9]+)*%?$"


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def template(words: Column) -> Column:
    """The template of each word."""

    def of(word: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1))
        core = _core(word)
        counted = before.rlike(r"[0-9]") | F.lower(before).isin(*NUMBER_WORDS)
        return (
            F.when(word.isin(*NUMBER_WORDS), F.lit(NUMBER))
            .when(word.rlike("^[a-z]+$") & ~counted.eqNullSafe(True), word)
            .when(core.rlike(_NUMBER) | F.lower(core).isin(*NUMBER_WORDS), F.lit(NUMBER))
            .when(core.rlike(r"^[0-9][0-9.,]*[\p{L}%°]{1,4}$"), F.lit(QUANTITY))
            .when((before.rlike(r"^[^\p{L}\p{N}]*[0-9][0-9.,:/]*$") | F.lower(before).isin(*NUMBER_WORDS)) & F.lower(core).isin(*UNITS), F.lit(UNIT))
            .when(core.rlike(r"^\p{Lu}\p{Ll}+$") & before.rlike(r"[^.!?:;|]$"), F.lit(NAME))
            .when(core == "", word)
            .otherwise(F.lower(core))
        )

    return F.transform(words, of)


def _core(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}$€£%+-]+|[^\p{L}\p{N}$€£%]+$", "")


def _firsts(words: Column) -> Column:
    """The templates that the first of words can have where a word stands before it, as a name or a unit."""
    core = _core(F.get(words, F.lit(0)))
    options = F.array(F.when(core.rlike(r"^\p{Lu}\p{Ll}+$"), F.lit(NAME)), F.when(F.lower(core).isin(*UNITS), F.lit(UNIT)))
    return F.filter(options, lambda x: x.isNotNull())


def _keyed(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (hashes, at, size) with the key of their window."""
    key = None
    for n in sizes:
        this = F.xxhash64(*[F.get("hashes", F.col("at") + j) for j in range(n)])
        key = this if key is None else F.when(F.col("size") == n, this).otherwise(key)
    return rows.withColumn("key", key)


def _windows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts (id, words, hashes) with a row for each window of each of the sizes: at, size, key."""
    n = F.size("hashes")
    rows = texts.withColumn("at", F.explode(F.when(n >= sizes[0], F.sequence(F.lit(0), n - sizes[0])).otherwise(F.array().cast("array<int>"))))
    if len(sizes) == 1:
        return _keyed(rows.withColumn("size", F.lit(sizes[0])), sizes)
    return _keyed(rows.withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes]))).filter(F.col("at") + F.col("size") <= n), sizes)


def _item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """items (id, words, hashes, size) with a row for each window: at, key, first.

    The first window comes once more for each other template that its first word can have, with the template in ``first``,
    else null.
    """
    own = F.struct(F.lit(None).cast("string").alias("first"), F.col("hashes").alias("hashes"))
    other = F.transform(_firsts(F.col("words")), lambda x: F.struct(x.alias("first"), F.concat(F.array(F.xxhash64(x)), F.slice("hashes", 2, F.col("size") - 1)).alias("hashes")))
    ways = items.withColumn("way", F.explode(F.concat(F.array(own), other))).withColumn("hashes", F.col("way.hashes")).withColumn("first", F.col("way.first")).drop("way")
    rows = ways.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))).filter((F.col("at") == 0) | F.col("first").isNull())
    return _keyed(rows, sizes)


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    words = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    return words.withColumn("hashes", F.transform(template(F.col("words")), lambda w: F.xxhash64(w)))


def _plain(words: Column) -> Column:
    """The words themselves, without signs at their ends and capitals, as hashes."""
    return F.transform(words, lambda w: F.xxhash64(F.when(_core(w) == "", w).otherwise(F.lower(_core(w)))))


def _joined(docs: DataFrame, rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows of docs that meet rows (key, size, ...); rows are broadcast if there are few."""
    if rows.count() <= BROADCAST_WINDOWS:
        rows = F.broadcast(rows)
    return _windows(docs, sizes).join(rows, ["key", "size"])


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """One row per (doc_id, item_id) found: n_windows that count, n_words of the item that they cover, the share of its words,
    exact (no slot differs).

    An item is found if at least ``share`` of its words, or ``run`` words along one alignment, are covered. Windows with fewer
    than LITERALS literal words do not count. Items of fewer words than the window are one window. The first word of an item
    matches itself also where the words before it in the document make it a name or a unit. Items without a window that counts,
    as those of numbers and names, are looked up by windows of their very words; those of fewer than LITERALS words are found
    where they are the whole document.

    Rows that repeat a doc_id count as one document, those that repeat an item_id as one item; rows with a null id or text are
    passed over, as are texts without words. Empty tables give no rows. Other columns are not read, whatever their names. Texts
    are taken whole: a long one is one array of hashes in memory.
    """
    docs, benchmark = docs.select("doc_id", text), benchmark.select("item_id", text)
    items = _hashed(benchmark, "item_id", text).filter(F.size("words") > 0).withColumn("shape", template(F.col("words")))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    literal = F.size(F.filter("shape", lambda w: ~w.startswith("\u0001")))
    part = lambda c: F.slice(F.col(c), F.col("at") + 1, F.col("size"))
    hashed = _hashed(docs, "doc_id", text)
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    met = []
    sizes = sorted(r["size"] for r in items.filter(F.col("size") >= LITERALS).select("size").distinct().collect())  # at most ``window`` numbers
    usable = None
    if sizes:
        rows = _item_windows(items.filter(F.col("size") >= LITERALS), sizes)
        rows = rows.select("key", "size", F.col("id").alias("item_id"), F.col("at").alias("item_at"), part("words").alias("item_words"), part("shape").alias("shape"), "first")
        rows = cut(rows.filter(literal >= F.least(F.lit(LITERALS), F.col("size"))).distinct())
        usable = rows.select(F.col("item_id").alias("id")).distinct()
        same = F.lower(_core(F.get("item_words", F.lit(0)))) == F.lower(_core(F.get("words", F.col("at"))))
        both = _joined(hashed, rows, sizes).filter(F.col("first").isNull() | same)
        z = F.transform(F.arrays_zip("shape", "item_words", part("words").alias("doc_words")), lambda x, i: F.struct((F.col("item_at") + i).alias("place"), x["shape"].alias("kind"), bare(x["item_words"]).alias("a"), bare(x["doc_words"]).alias("b")))
        both = both.select("item_id", F.col("id").alias("doc_id"), "item_at", "size", (F.col("at") - F.col("item_at")).alias("shift"), z.alias("z"))
        met.append(both.withColumn("slots", F.filter("z", lambda x: x["kind"].startswith("\u0001"))).drop("z"))
    others = items if usable is None else items.join(usable, "id", "left_anti")
    few = sorted(r["size"] for r in others.select("size").distinct().collect())
    none = F.array().cast("array<struct<place:int,kind:string,a:string,b:string>>").alias("slots")
    if long := [x for x in few if x >= LITERALS]:
        rows = _keyed(others.filter(F.col("size") >= LITERALS).withColumn("hashes", _plain(F.col("words"))).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))), long)
        rows = cut(rows.select("key", "size", F.col("id").alias("item_id"), F.col("at").alias("item_at")).distinct())
        met.append(_joined(hashed.withColumn("hashes", _plain(F.col("words"))), rows, long).select("item_id", F.col("id").alias("doc_id"), "item_at", "size", (F.col("at") - F.col("item_at")).alias("shift"), none))
    if [x for x in few if x < LITERALS]:
        whole = others.filter(F.col("size") < LITERALS).select(F.xxhash64(_plain(F.col("words"))).alias("key"), F.col("id").alias("item_id"), "size").distinct()
        texts = hashed.filter(F.size("words") < LITERALS).select(F.xxhash64(_plain(F.col("words"))).alias("key"), F.col("id").alias("doc_id"))
        met.append(texts.join(whole, "key").select("item_id", "doc_id", F.lit(0).alias("item_at"), "size", F.lit(0).alias("shift"), none))
    if not met:
        kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows long, n_words long, share double, exact boolean")
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    return _decided(every, items, share, run)


def _decided(met: DataFrame, items: DataFrame, share: float, run: int) -> DataFrame:
    """The rows of find() from windows met (doc_id, item_id, item_at, size, shift, slots)."""
    lines = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.struct("item_at", "size", "slots")).alias("windows"))
    # the votes: each place of the item once
    lines = lines.withColumn("places", F.array_distinct(F.flatten("windows.slots")))
    of = lambda x, y: (x["kind"] == y["kind"]) & (x["a"] == y["a"])
    votes = lambda x: F.size(F.filter("places", lambda y: of(x, y) & (x["b"] == y["b"])))
    # of equal votes the value that sorts last, so that the order of rows does not matter
    lines = lines.withColumn("votes", F.transform("places", lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), votes(x).alias("n"), x["b"].alias("b"))))
    winner = lambda x: F.array_max(F.transform(F.filter("votes", lambda y: of(x, y)), lambda y: F.struct(y["n"].alias("n"), y["b"].alias("b"))))["b"]
    good = F.filter("windows", lambda w: F.forall(w["slots"], lambda x: x["b"] == winner(x)))
    covered = lambda windows: F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(w["item_at"], w["item_at"] + w["size"] - 1))))
    lines = lines.withColumn("good", good).filter(F.size("good") > 0)
    lines = lines.select("doc_id", "item_id", F.transform("good", lambda w: w["item_at"]).alias("at"), covered("good").alias("words"), F.exists("good", lambda w: F.exists(w["slots"], lambda x: x["a"] != x["b"])).alias("changed"))
    found = lines.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_words"),
        F.max(F.size("words")).alias("longest"),
        F.min(~F.col("changed")).alias("exact"),
    )
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.min(F.size("words")).alias("of"))
    found = found.join(sizes, "item_id").withColumn("share", F.least(F.lit(1.0), F.col("n_words") / F.col("of")))
    return found.filter((F.col("share") >= share) | (F.col("longest") >= run)).select("doc_id", "item_id", "n_windows", "n_words", "share", "exact")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found, see find().

    Rows with a null doc_id or text stay, rows that repeat a doc_id stay or go together; columns are kept whatever their names.
    """
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
