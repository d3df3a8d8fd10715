"""Labelled frames: the one form in which operators see data.

A labelled frame has ``row_idx`` (long), ``label`` in its own type, ``label_s`` (its text form) and
``features`` (array of doubles).  ``Labelled`` carries it with what the driver knows of it: names and
the dictionary of classes, both small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import DataError
from quillon.sources import csvfile
from quillon.sources.shared import bounded, durable

#: Tokens that CSV input takes for missing values (fixed values of the common CSV reader's defaults).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


#: Most classes that the driver lists.
CLASSES = 10_000


def _let(value: Column, use) -> Column:
    """use(value), computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def float_text(x: Column, kind: T.DataType) -> Column:
    """A floating number as Python writes it: the fewest digits that tell it apart, an exponent below 1e-4 and from 1e16 on."""

    def parts(text):
        """Digits without zeros at either end, and where the point is from their start."""
        found = [F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$", i) for i in (1, 2, 3)]
        digits = F.concat(found[0], found[1])
        led = F.ltrim(digits, F.lit("0"))
        point = F.length(found[0]) + F.coalesce(F.nullif(found[2], F.lit("")).cast("int"), F.lit(0)) - F.length(digits) + F.length(led)
        return F.struct(F.rtrim(led, F.lit("0")).alias("d"), point.alias("p"))

    def fewer(n):
        """One digit less, if that still reads back as the same number: Java writes one too many at times."""
        near = F.round(n["d"].cast("decimal(20,0)") / 10).cast("decimal(20,0)").cast("string")
        point = n["p"] + F.length(near) - F.length(n["d"]) + 1
        same = F.concat(F.lit("0."), near, F.lit("e"), point.cast("string")).cast(kind) == F.abs(x)
        return F.when((F.length(n["d"]) > 1) & same, F.struct(F.rtrim(near, F.lit("0")).alias("d"), point.alias("p"))).otherwise(n)

    def laid_out(n):
        d, p, size = n["d"], n["p"], F.length(n["d"])
        e = p - 1
        point = F.when(size > 1, F.concat(F.substring(d, 1, 1), F.lit("."), d.substr(F.lit(2), size))).otherwise(d)
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return (
            F.when(d == "", F.lit("0.0"))
            .when((e < -4) | (e >= 16), F.concat(point, F.lit("e"), power))
            .when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
            .when(p >= size, F.concat(d, F.repeat(F.lit("0"), p - size), F.lit(".0")))
            .otherwise(F.concat(d.substr(F.lit(1), p), F.lit("."), d.substr(p + 1, size)))
        )

    text = x.cast("string")
    finite = _let(F.ltrim(text, F.lit("-")), lambda t: _let(parts(t), lambda n: _let(fewer(n), lambda m: _let(fewer(m), laid_out))))
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), finite))


def label_text(label: Column, kind: T.DataType) -> Column:
    """A label's text form, as Python writes it: booleans are True and False, floating numbers have Python's exponents."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(label, kind)
    text = label.cast("string")
    return F.initcap(text) if isinstance(kind, T.BooleanType) else text


@dataclass
class Labelled:
    frame: DataFrame
    feature_names: list[str]
    target: str
    width: int
    path: str | None = None
    #: The input's rows: row_idx and columns c0, c1... whose names are ``source_names``.
    source: DataFrame | None = field(default=None, repr=False)
    source_names: list[str] = field(default_factory=list)
    drop_cols: list[str] = field(default_factory=list)
    #: (label, text, rows) of each class in the order of texts; of more than CLASSES classes there is ``class_table`` alone.
    class_counts: list[tuple] = field(default_factory=list)
    #: label, label_s and n of each class, where there are too many for the driver.
    class_table: DataFrame | None = field(default=None, repr=False)
    n_classes: int = 0
    n: int = 0
    #: Rows of the largest class.
    largest: int = 0
    #: Rows are numbered from 0 on without gaps; else row numbers are a key of the input, ``low`` its least value.
    gapless: bool = False
    low: int = 0

    @property
    def classes(self) -> list[str]:
        if self.class_table is not None:
            raise DataError(f"{self.n_classes} classes can't be listed on the driver; {CLASSES} are the most")
        return [text for _, text, _ in self.class_counts]

    def per_class(self) -> DataFrame:
        """label, label_s, n of each class."""
        if self.class_table is not None:
            return self.class_table
        kind = self.frame.schema["label"].dataType
        schema = T.StructType([T.StructField("label", kind), T.StructField("label_s", T.StringType()), T.StructField("n", T.LongType())])
        return self.frame.sparkSession.createDataFrame(self.class_counts, schema)


def _place(names: list[str], name: str, what: str) -> int:
    """A column's place; names are told apart by case."""
    places = [i for i, c in enumerate(names) if c == name]
    if len(places) != 1:
        raise DataError(f"{what} is {name!r}, which {len(places)} columns are named; there are {names}")
    return places[0]


def _positional(df: DataFrame) -> DataFrame:
    """Columns c0, c1...: no name of the input can clash with another or with those used here."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _labelled_columns(flat: DataFrame, names: list[str], target: str, drop_cols: list[str], features: list[str] | None, index: int | None = None, **more) -> Labelled:
    """From row_idx and columns c0, c1... with the given names."""
    at = _place(names, target, "the target column")
    drops = {_place(names, c, "a column to drop") for c in drop_cols}
    if features is None:
        places = [i for i in range(len(names)) if i != at and i not in drops and i != index]
    else:
        places = [_place(names, c, "a feature") for c in features]
    kinds = {f.name: f.dataType for f in flat.schema.fields}
    bad = [names[i] for i in places if not isinstance(kinds[f"c{i}"], NUMERIC)]
    if bad:
        raise DataError(f"features that are not numbers: {bad}; convert or drop them")
    vector = F.array(*[F.coalesce(F.col(f"c{i}").cast("double"), F.lit(float("nan"))) for i in places]).cast("array<double>")
    label = F.col(f"c{at}")
    frame = flat.select("row_idx", label.alias("label"), label_text(label, kinds[f"c{at}"]).alias("label_s"), vector.alias("features"))
    return _labelled(frame, [names[i] for i in places], target, len(places), source=flat, source_names=names, drop_cols=list(drop_cols), **more)


def from_columns(df: DataFrame, target: str, index: str | None = None, drop_cols: list[str] | None = None, features: list[str] | None = None) -> Labelled:
    """A labelled frame from a table's columns; ``index`` names its key, else rows are numbered in their order.

    Boolean features count as 0 and 1, missing ones as NaN; missing labels and keys are an error. Keys have to be
    distinct: splitters that rank rows refuse repeated ones. Columns may have any names, told apart by case.
    """
    names, flat = df.columns, _positional(df)
    if index is None:
        return _labelled_columns(numbered(flat), names, target, list(drop_cols or []), features, gapless=True)
    key = _place(names, index, "the key")
    drops = [c for c in drop_cols or [] if c != index]
    return _labelled_columns(flat.withColumn("row_idx", F.col(f"c{key}").cast("long")), names, target, drops, features, key)


def from_vectors(df: DataFrame, index: str, vector: str, target: str) -> Labelled:
    """A labelled frame from an array column."""
    names, flat = df.columns, _positional(df)
    key, at, of = (F.col(f"c{_place(names, c, what)}") for c, what in ((index, "the key"), (target, "the target column"), (vector, "the vector")))
    kind = flat.select(at).schema[0].dataType
    values = F.transform(of.cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    frame = flat.select(key.cast("long").alias("row_idx"), at.alias("label"), label_text(at, kind).alias("label_s"), values.alias("features"))
    found = _labelled(frame, [], target, None, source=flat.withColumn("row_idx", key.cast("long")), source_names=names)
    found.feature_names = [f"f{i}" for i in range(found.width)]
    return found


def _labelled(frame, names, target, width, **more) -> Labelled:
    """One pass tells the classes, whether labels or keys are missing, and how wide vectors are."""
    size = F.size("features")
    facts = [F.count(F.lit(1)).alias("n"), F.min(size).alias("narrow"), F.max(size).alias("wide")]
    if not more.get("gapless"):
        facts += [F.min("row_idx").alias("low"), F.count("row_idx").alias("keys")]
    # The label is a key beside its text: a least label would make Spark sort all rows.
    table = frame.groupBy("label_s", "label").agg(*facts)
    seen = table.limit(CLASSES + 1).collect()
    many = None
    if len(seen) > CLASSES:
        # Too many for the driver: they stay a table, and what is known of them comes from it.
        table = durable(table, "classes")
        whole = [F.max(F.col("label_s").isNull()).alias("unknown"), F.min("narrow").alias("narrow"), F.max("wide").alias("wide")]
        if not more.get("gapless"):
            whole += [F.min("low").alias("low"), F.sum("keys").alias("keys")]
        many = table.agg(F.sum("n").alias("n"), *whole).first()
    if many["unknown"] if many else any(r["label_s"] is None for r in seen):
        raise DataError(f"target column {target!r} has missing labels")
    rows = [many] if many else seen
    if width is None:
        narrow, wide = min((r["narrow"] for r in rows), default=0), max((r["wide"] for r in rows), default=0)
        if narrow != wide:
            raise DataError(f"vectors have {narrow} to {wide} coordinates")
        width = narrow
    if not more.get("gapless"):
        if any(r["keys"] < r["n"] for r in rows):
            raise DataError("the key that numbers rows has missing values")
        more["low"] = min((r["low"] for r in rows), default=0)
    if many:
        per_class = durable(table.groupBy("label_s").agg(F.min("label").alias("label"), F.sum("n").alias("n")).select("label", "label_s", "n"), "classes")
        sizes = per_class.agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest")).first()
        return Labelled(frame, names, target, width, class_table=per_class, n_classes=sizes["classes"], n=many["n"], largest=sizes["largest"], **more)
    classes: dict[str, tuple] = {}
    for r in sorted(seen, key=lambda r: (r["label_s"], r["label"])):
        label, _, n = classes.get(r["label_s"], (r["label"], None, 0))
        classes[r["label_s"]] = (label, r["label_s"], n + r["n"])
    counts = [classes[k] for k in sorted(classes)]
    sizes = [n for _, _, n in counts]
    return Labelled(frame, names, target, width, class_counts=counts, n_classes=len(counts), n=sum(sizes), largest=max(sizes, default=0), **more)


def numbered(df: DataFrame) -> DataFrame:
    """The rows with ``row_idx`` from 0 on, without gaps, in the order of files and their rows or else of partitions.

    Columns may not be named as those that are added on the way: ``from_columns`` takes any names.

    A row's number never depends on how often or with which partitions the input is evaluated: rows of Parquet
    files are known by their place in the file, all others are written once with the place they have.
    """
    taken = {"row_idx", "_part", "_at", "_before"} & {c.lower() for c in df.columns}
    if taken:
        raise DataError(f"rows can't be numbered beside columns named {sorted(taken)}")
    if _plain_parquet(df):
        marked = df.withColumn("_part", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.row_index"))
    else:
        marked = placed(df)
    return counted(marked, "row_idx")


def _plain_parquet(df: DataFrame) -> bool:
    """Whether each row of the frame is one row of a Parquet file, and each row of the files is there."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or not plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
        return False
    # A column of the files' own named as Spark's would hide it.
    own = any(name.lower() == "_metadata" for name in plan.relation().schema().fieldNames())
    return not own and plan.relation().fileFormat().toString() == "Parquet"


def placed(df: DataFrame) -> DataFrame:
    """The rows written with their partition (``_part``) and place in it (``_at``)."""
    # monotonically_increasing_id has the partition in its upper bits and counts within it in the lower 33.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return durable(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", at), "placed")


def counted(marked: DataFrame, name: str, first: int = 0) -> DataFrame:
    """``name``: the number of a row that is the ``_at``-th of its ``_part``; parts follow each other in order.

    Only the parts' sizes, as many rows as files or partitions, meet on the driver.
    """
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("top")).collect()
    before = {}
    for r in sorted(sizes, key=lambda r: r["_part"]):
        if r["top"] != r["n"] - 1:
            raise DataError(f"{r['_part']} has {r['n']} rows, the last being number {r['top']}")
        before[r["_part"]] = first
        first += r["n"]
    if len(before) < 2:
        return marked.withColumn(name, F.col("_at") + F.lit(min(before.values(), default=0))).drop("_part", "_at")
    kind = marked.schema["_part"].dataType.simpleString()
    offsets = marked.sparkSession.createDataFrame(list(before.items()), f"_part {kind}, _before long")
    met = marked.join(bounded(offsets, len(before)), "_part", "left")
    at = F.when(F.col("_before").isNull(), F.raise_error(F.lit("rows of a part that was not counted"))).otherwise(F.col("_before") + F.col("_at"))
    return met.withColumn(name, at).drop("_part", "_at", "_before")


# --- CSV ---------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise DataError(f"no such file: {path}")
    if not path.lower().endswith(".csv"):
        raise DataError(f"a .csv file is expected, not {path}")


def _names(header: list[str]) -> list[str]:
    """Column names, repeats told apart by a number behind them."""
    names: list[str] = []
    for i, name in enumerate(header):
        name, n = (name.removeprefix("\ufeff") if not i else name) or f"Unnamed: {i}", 0
        while (found := name if not n else f"{name}.{n}") in names:
            n += 1
        names.append(found)
    return names


def _kind(whole: int, number: int, truth: int, n: int) -> str:
    if n == whole:
        return "bigint"
    if n == number:
        return "double"
    return "boolean" if n == truth else "string"


WHOLE = r"^[+-]?\d{1,18}$"
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)$"
TRUTH = r"^(?i:true|false)$"


def read_csv(spark: SparkSession, path: str, target: str = "class", drop_cols: list[str] | None = None) -> Labelled:
    """A labelled frame from one CSV file with a header, types being told from all its values."""
    _exists(spark, path)
    read = csvfile.records(spark, path)
    names, safe = _names(read.header), [f"c{i}" for i in range(len(read.header))]
    fields = [F.get("fields", F.lit(i)) for i in range(len(safe))]
    text = read.frame.select("row_idx", F.size("fields").alias("width"), *[F.when(~x.isin(MISSING), x).alias(c) for c, x in zip(safe, fields)])
    trimmed = {c: F.trim(F.col(c)) for c in safe}
    tests = [F.coalesce(F.max("width"), F.lit(0)).alias("width")]
    for c in safe:
        for kind, pattern in (("w", WHOLE), ("n", NUMBER), ("t", TRUTH)):
            tests.append(F.count(F.when(F.lower(trimmed[c]).rlike(pattern), 1)).alias(f"{c}_{kind}"))
        tests.append(F.count(c).alias(f"{c}_all"))
        tests.append(F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_null"))
    seen = text.agg(*tests).first()
    if seen["width"] > len(names):
        raise DataError(f"{path} has rows with {seen['width']} fields under a header of {len(names)}")
    typed = []
    for c in safe:
        kind = _kind(seen[f"{c}_w"], seen[f"{c}_n"], seen[f"{c}_t"], seen[f"{c}_all"])
        if kind == "bigint" and seen[f"{c}_null"]:
            kind = "double"  # a column of whole numbers with gaps holds doubles
        if kind == "boolean" and seen[f"{c}_null"]:
            kind = "string"
        value = F.col(c) if kind == "string" else trimmed[c].cast(kind)
        typed.append(value.alias(c))
    return _labelled_columns(text.select("row_idx", *typed), names, target, list(drop_cols or []), None, gapless=True, path=path)
