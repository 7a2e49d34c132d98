"""The window table as text: header lines, then a row per window with a packed cell for each sample."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import DEFAULT_WEIGHTS, ibs_code, ibs_text, score, two_places
from .files import places

#: Fixed values of the format.
COLUMNS = ("CHROM", "START", "END", "ID", "TOTAL_KMERS", "INFO", "FORMAT")
CELL = "GT:VA:OB:ID:LD:RD:KD:SC"
INFO = (("IS", "Float", "least score"), ("XS", "Float", "greatest score"), ("MS", "Float", "mean score"), ("IO", "Integer", "least observed k-mers"), ("XO", "Integer", "greatest observed k-mers"), ("MO", "Float", "mean observed k-mers"), ("IV", "Integer", "least variations"), ("XV", "Integer", "greatest variations"), ("MV", "Float", "mean variations"), ("EFFLEN", "Integer", "effective length"))
FORMAT = (("GT", "Integer", "region number"), ("VA", "Integer", "variations"), ("OB", "Integer", "observed k-mers"), ("ID", "Integer", "inner distance"), ("LD", "Integer", "left distance"), ("RD", "Integer", "right distance"), ("KD", "Float", "mean k-mer depth"), ("SC", "Float", "score"))
PARAMS = ("window", "step", "kmer", "IBS", "nwindow", "wti", "wtt", "wtk")


@dataclass
class Header:
    reference: str = ""
    contigs: dict[str, int] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    commands: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @property
    def weights(self) -> tuple[float, float, float]:
        return tuple(float(self.params.get(p, d)) for p, d in zip(("wti", "wtt", "wtk"), DEFAULT_WEIGHTS))

    def lines(self, date: str | None = None) -> list[str]:
        out = ["##format=WT1.0", f"##date={date or datetime.date.today().isoformat()}", "##source=helixloom", f"##reference={self.reference}"]
        out += [f"##contig=<ID={c},length={n}>" for c, n in self.contigs.items()]
        out += [f'##{kind}=<ID={i},Type={t},Description="{d}">' for kind, rows in (("INFO", INFO), ("FORMAT", FORMAT)) for i, t, d in rows]
        out += [f"##PARAM=<ID={p},value={self.params[p]}>" for p in PARAMS if p in self.params]
        out += [f"##CMD={c}" for c in self.commands]
        return [*out, "#" + "\t".join([*COLUMNS, *self.samples])]


def _field(line: str, name: str) -> str:
    return line.split(f"{name}=", 1)[1].split(",", 1)[0].rstrip(">")


def read_header(spark: SparkSession, path: str) -> Header:
    """The header: a few lines for each contig, which the driver holds. Version and date are not kept."""
    h = Header()
    for r in sorted(places(spark, path).where(F.col("value").startswith("#")).collect(), key=lambda r: r.place):
        line = r.value
        if line.startswith("##reference="):
            h.reference = line.partition("=")[2]
        elif line.startswith("##contig="):
            h.contigs[_field(line, "ID")] = int(_field(line, "length"))
        elif line.startswith("##PARAM="):
            h.params[_field(line, "ID")] = _field(line, "value")
        elif line.startswith("##CMD="):
            h.commands.append(line.partition("=")[2])
        elif line.startswith("#CHROM"):
            h.samples = line.split("\t")[len(COLUMNS) :]
    return h


def read_windows(spark: SparkSession, path: str, header: Header | None = None) -> DataFrame:
    """The long table: a row per window and sample. Scores are computed anew with the header's weights; counts come
    from depth times observed k-mers, so they are as exact as two decimals of depth allow."""
    h = header or read_header(spark, path)
    rows = places(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    rows = rows.withColumn("c", F.split("value", "\t"))
    samples = F.array(*[F.lit(s) for s in h.samples])
    base = rows.select(
        F.col("c")[0].alias("chrom"), F.col("c")[1].cast("int").alias("start"), F.col("c")[2].cast("int").alias("end"), F.col("c")[3].alias("win_id"), F.col("c")[4].cast("int").alias("total_kmers"),
        F.str_to_map(F.col("c")[5], F.lit(";"), F.lit("="))["EFFLEN"].cast("int").alias("eff_len"), F.col("place").alias("win_ord"),
        F.posexplode(F.slice("c", len(COLUMNS) + 1, F.size("c") - len(COLUMNS))).alias("sample_idx", "cell"),
    )
    p = F.split("cell", ":")
    out = base.withColumns({"sample": F.element_at(samples, F.col("sample_idx") + 1), "ibs": ibs_code(p[0]), "va": p[1].cast("int"), "ob": p[2].cast("int"), "id": p[3].cast("int"), "ld": p[4].cast("int"), "rd": p[5].cast("int"), "kd": p[6].cast("double")})
    out = out.withColumns({"kmer_count": F.floor(F.col("kd") * F.col("ob") + 0.5), "score": score(F.col("ob"), F.col("total_kmers"), F.col("id"), F.col("ld") + F.col("rd"), F.col("eff_len"), h.weights)})
    return out.drop("cell")


def rows_as_text(windows: DataFrame) -> DataFrame:
    """(chrom, start, end, win_id, line): a line per window, cells in order of sample_idx."""
    cell = F.concat_ws(":", ibs_text(F.col("ibs")), *[F.col(c).cast("string") for c in ("va", "ob", "id", "ld", "rd")], two_places(F.col("kd")), two_places(F.col("score")))
    keys = ["chrom", "start", "end", "win_id", "total_kmers", "eff_len"]
    g = windows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", cell.alias("cell")))).alias("cells"),
        *[f(c).alias(n) for n, f, c in (("IS", F.min, "score"), ("XS", F.max, "score"), ("MS", F.avg, "score"), ("IO", F.min, "ob"), ("XO", F.max, "ob"), ("MO", F.avg, "ob"), ("IV", F.min, "va"), ("XV", F.max, "va"), ("MV", F.avg, "va"))],
    )
    text = {"IS": two_places, "XS": two_places, "MS": two_places, "MO": two_places, "MV": lambda c: c.cast("float").cast("string")}
    info = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), text.get(n, lambda c: c.cast("string"))(F.col(n))) for n in ("IS", "XS", "MS", "IO", "XO", "MO", "IV", "XV", "MV")], F.concat(F.lit("EFFLEN="), F.col("eff_len").cast("string")))
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chrom", "start", "end", "win_id", "total_kmers")], info, F.lit(CELL), F.array_join(F.transform("cells", lambda x: x["cell"]), "\t"))
    return g.select("chrom", "start", "end", "win_id", line.alias("line"))


def write_windows(windows: DataFrame, header: Header, path: str, date: str | None = None) -> None:
    """The header, then windows in order of the header's contigs and their starts: a folder of parts that follow each
    other by their names.

    Every window must have a cell for each of the header's samples, and one place, number of k-mers and effective
    length in all of them.
    """
    spark = windows.sparkSession
    own = F.struct("start", "end", "total_kmers", "eff_len")
    found = windows.groupBy("chrom", "win_id").agg(F.count_distinct("sample_idx").alias("n"), (F.min(own) == F.max(own)).alias("alike"))
    for wrong in found.where((F.col("n") != len(header.samples)) | ~F.col("alike")).limit(1).collect():
        if wrong.n != len(header.samples):
            raise ValueError(f"window {wrong.win_id} has {wrong.n} of {len(header.samples)} samples")
        raise ValueError(f"samples differ in the place, k-mers or length of window {wrong.win_id}")
    ranks = spark.createDataFrame([(c, i + 1) for i, c in enumerate(header.contigs)], "_contig string, _rank long")
    body = rows_as_text(windows).join(F.broadcast(ranks), F.col("chrom") == F.col("_contig"), "left")  # a row per contig
    body = body.select(F.lit(1).alias("part"), F.coalesce("_rank", F.lit(0)).alias("a"), F.col("start").cast("long").alias("b"), F.col("end").cast("long").alias("c"), F.col("win_id").alias("d"), "line")
    head = spark.createDataFrame([(0, 0, i, 0, "", line) for i, line in enumerate(header.lines(date))], body.schema)
    head.union(body).orderBy("part", "a", "b", "c", "d").select(F.col("line").alias("value")).write.text(path)
