"""What an experiment leaves in its run directory, on any file system that Spark can write.

Tables are formatted and written by executors; small documents are written through Hadoop's file systems.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ValidationError
from quillon.operators.folds import partitions
from quillon.sources.labelled import Labelled


def stamp() -> str:
    return datetime.now().strftime("%Y%m%d-%H%M%S")


@dataclass(frozen=True)
class Place:
    """A file or folder by its path, local or any that Hadoop knows."""

    spark: SparkSession
    path: str

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.path.rstrip('/')}/{name}")

    def __str__(self) -> str:
        return self.path

    def _hadoop(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self) -> bool:
        system, place = self._hadoop()
        return system.exists(place)

    def make(self) -> None:
        system, place = self._hadoop()
        system.mkdirs(place)

    def delete(self) -> None:
        system, place = self._hadoop()
        system.delete(place, True)

    def move(self, to: Place) -> None:
        """Move to a path that may hold an earlier result, whose folder is made if need be."""
        system, place = self._hadoop()
        target = to._hadoop()[1]
        if target.getParent() is not None:
            system.mkdirs(target.getParent())
        system.delete(target, True)
        system.rename(place, target)

    def size(self) -> int:
        system, place = self._hadoop()
        return system.getFileStatus(place).getLen()

    def names(self) -> list[str]:
        system, place = self._hadoop()
        return sorted(x.getPath().getName() for x in system.listStatus(place))

    def write_bytes(self, data: bytes) -> None:
        system, place = self._hadoop()
        out = system.create(place, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def write_text(self, text: str) -> None:
        self.write_bytes(text.encode())

    def read_text(self) -> str:
        """A file's text, or that of a table's parts one after the other."""
        return "".join(r[0] for r in self.spark.read.text(self.path, wholetext=True).orderBy(F.input_file_name()).collect())


@dataclass(frozen=True)
class RunDirectory:
    place: Place

    @classmethod
    def create(cls, spark: SparkSession, outputs: str, run_name: str, when: str) -> RunDirectory:
        place = Place(spark, outputs) / "runs" / f"{when}__{run_name}"
        place.make()
        return cls(place)

    @property
    def path(self) -> str:
        return self.place.path

    def __truediv__(self, name: str) -> Place:
        return self.place / name


def write_json(place: Place, value) -> None:
    place.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def _lines(rows, header) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header:
        writer.writerow(header)
    writer.writerows([["" if v is None else v for v in row] for row in rows])
    return out.getvalue()


def _formatted(ordered: DataFrame, columns: list[str], header: list[str] | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The keys and CSV text (value) of sorted rows, under a header (if any) at the start of each task and each run of equal keys."""

    def run(batches):
        last = None
        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in columns))) or [()] * batch.num_rows
            groups = list(zip(*(batch.column(k).to_pylist() for k in keys))) or [()] * batch.num_rows
            at = 0
            while at < len(groups):
                end = at
                while end < len(groups) and groups[end] == groups[at]:
                    end += 1
                text = _lines(cells[at:end], header if groups[at] != last else None).removesuffix("\n")
                yield pa.RecordBatch.from_pydict({"value": [text]} | {k: [v] for k, v in zip(keys, groups[at])})
                last, at = groups[at], end

    return ordered.mapInArrow(run, ", ".join(["value string", *(f"{k} {ordered.schema[k].dataType.simpleString()}" for k in keys)]))


#: File systems whose files tasks open themselves.
OPENED = {"file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs"}


def _copier(uris: list[str], folder: str):
    """Copies the files into one, under a name of this attempt's own, so that one that is lost leaves no half of a file."""

    def run(batches):
        import uuid

        from pyarrow import fs

        for batch in batches:
            for _ in range(batch.num_rows):
                at = f"{folder}/joined-{uuid.uuid4().hex}"
                system, path = fs.FileSystem.from_uri(at)
                with system.open_output_stream(path, compression=None) as sink:
                    for uri in uris:
                        of, inner = fs.FileSystem.from_uri(uri)
                        with of.open_input_stream(inner, compression=None) as source:
                            while chunk := source.read(COPIED):
                                sink.write(chunk)
                yield pa.RecordBatch.from_pydict({"at": [at]})

    return run


def _appended(parts: list[Place], target: Place) -> None:
    """One file of the parts' bytes, in their order: joined by the file system where it can, else copied as they are.

    Copying holds a few bytes at a time, whatever the parts' size, and sorts or formats nothing; one task does it, or the driver
    on file systems that tasks can't open by themselves.
    """
    spark = target.spark
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system, first = parts[0]._hadoop()
    rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
    for i, part in enumerate(parts[1:]):
        rest[i] = part._hadoop()[1]
    try:
        system.concat(first, rest)
        return parts[0].move(target)
    except (Py4JJavaError, PySparkException):  # most file systems have no such operation
        pass
    uris = [system.makeQualified(p._hadoop()[1]).toString() for p in parts]
    if uris[0].partition(":")[0] in OPENED:
        made = spark.range(0, 1, 1, 1).mapInArrow(_copier(uris, uris[0].rpartition("/")[0]), "at string").collect()
        return Place(spark, made[0]["at"]).move(target)
    out = target._hadoop()[0].create(target._hadoop()[1], True)
    try:
        for part in parts:
            source = system.open(part._hadoop()[1])
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()


def _settle(made: Place, target: Place, header: list[str], single: bool) -> None:
    """Move what Spark has written to where it belongs: its parts as one file, or the folder of parts."""
    found = [made / x for x in made.names() if x.startswith("part-")] if made.exists() else []
    parts = [p for p in found if p.size()]
    if not parts:
        target.write_text(_lines([], header))
    elif not single:
        made.move(target)
    elif len(parts) == 1:
        parts[0].move(target)
    else:
        _appended(parts, target)


def write_csv(df: DataFrame, place: Place, order: list[str], single: bool = True) -> None:
    """Rows in order as CSV: one file, or a folder of parts in the order of their names.

    Rows are sorted by ranges and formatted by as many tasks as they need; a single file is made of the parts' bytes.
    """
    spark, made = df.sparkSession, Place(df.sparkSession, f"{place.path}.parts")
    names = df.columns
    flat, keys = df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in order]
    # Spark joins small ranges, so that a small result is one part.
    ordered = flat.sort(*keys)
    _formatted(ordered, flat.columns, None if single else names).write.mode("overwrite").text(made.path)
    if single:
        (made / "part--header").write_text(_lines([], names))
    _settle(made, place, names, single)
    made.delete()


def write_matrix(df: DataFrame, place: Place) -> None:
    """A wide matrix whose first column names the rows and has no header: as many rows as labels."""
    place.write_text(_lines([list(r) for r in df.collect()], ["", *df.columns[1:]]))


#: Bytes that a task copies at a time.
COPIED = 8 << 20
#: Rows that an export of leave-one-out may write: folds times rows, the square of the input's.
EXPORT_ROWS = 50_000_000


def export_partitions(data: Labelled, assigned: DataFrame, folder: Place, n_folds: int, leave_one_out: bool = False, single: bool = True) -> None:
    """fold_<f>/train.csv and test.csv with the original columns but those dropped, by row number, in one job.

    With ``single`` each is one file, else a folder of parts in order that any number of tasks write.
    """
    if leave_one_out and n_folds**2 > EXPORT_ROWS:
        raise ValidationError(f"leaving out each of {n_folds} rows would export {n_folds**2} rows; {EXPORT_ROWS} are the most")
    places = [i for i, name in enumerate(data.source_names) if name not in data.drop_cols]
    safe, kept = [f"c{i}" for i in places], [data.source_names[i] for i in places]
    rows = partitions(data.source.select("row_idx", *safe).join(assigned.select("row_idx", "fold_id"), "row_idx"), n_folds)
    keys, made = ("fold", "role"), folder / "parts"
    dealt = rows.repartition(*keys) if single else rows.repartitionByRange(*keys, "row_idx")
    _formatted(dealt.sortWithinPartitions(*keys, "row_idx"), safe, kept, keys).write.partitionBy(*keys).mode("overwrite").text(made.path)
    for fold in range(n_folds):
        for role in ("train", "test"):
            _settle(made / f"fold={fold}" / f"role={role}", folder / f"fold_{fold}" / f"{role}.csv", kept, single)
    made.delete()


def draw(values: list[list[float]], labels: list[str], place: Place, title: str, normalised: bool = False, cmap: str = "Blues") -> bool:
    """A matrix as a PNG, where matplotlib is installed; whether it was drawn."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    figure, axes = pyplot.subplots(figsize=(6, 6), dpi=150)
    shown = axes.imshow(values, cmap=cmap)
    figure.colorbar(shown)
    for i, row in enumerate(values):
        for j, x in enumerate(row):
            axes.text(j, i, f"{x:.2f}" if normalised else f"{int(x)}", ha="center", va="center")
    axes.set(title=title, xlabel="Predicted label", ylabel="True label", xticks=range(len(labels)), yticks=range(len(labels)))
    axes.set_xticklabels(labels, rotation=45)
    axes.set_yticklabels(labels)
    figure.tight_layout()
    out = io.BytesIO()
    figure.savefig(out, format="png")
    place.write_bytes(out.getvalue())
    pyplot.close(figure)
    return True


def tidy(cm: DataFrame, title: str, value: str) -> DataFrame:
    """What a drawing shows: true_label, pred_label, value, title."""
    return cm.select("true_label", "pred_label", F.col(value).cast("double").alias("value"), F.lit(title).alias("title"))
