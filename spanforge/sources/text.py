"""Readers and writers of the usual text formats, gzipped ones by their extension.

Lines are parsed by column expressions. Where a row must know its place in the
file, a ``line`` number is made from the file's sorted offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.track import clean
from ..shared import write_table


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of text files; ``line`` grows within a file."""
    return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())


def fields(value: Column) -> Column:
    """A line's fields: by tabs where it has any, else by white space."""
    return F.when(F.contains(value, F.lit("\t")), F.split(value, "\t")).otherwise(F.split(F.trim(value), r"\s+"))


def _at(i: int) -> Column:
    return F.get("_f", i)


def _need(n: int, what: str) -> Column:
    return F.when(F.size("_f") < n, F.raise_error(F.concat(F.lit(f"{what} needs {n} fields: "), "value")))


def _split(df: DataFrame, n: int, what: str) -> DataFrame:
    checked = df.withColumn("_f", fields(F.col("value")))
    return checked.withColumn("_f", F.coalesce(_need(n, what).cast("array<string>"), "_f"))


# BED ------------------------------------------------------------------------

BED_COLUMNS = {3: [], 6: ["name", "score"], 9: ["name", "score", "thickStart", "thickEnd", "itemRgb"]}


def read_bed(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """BED of 3, 6 or 9 columns as intervals; track and browser lines are left out."""
    if columns not in BED_COLUMNS:
        raise ValueError("BED has 3, 6 or 9 columns")
    body = lines(spark, path).where(~F.col("value").rlike(r"^(track|browser)\b"))
    f = _split(body, columns, f"BED{columns}")
    out = [_at(0).alias("seqname"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end")]
    out.append((F.substring(_at(5), 1, 1) if columns >= 6 else F.lit("*")).alias("strand"))
    out.append(F.col("line").alias("row_id"))
    if columns >= 6:
        out += [_at(3).alias("name"), _at(4).cast("long").alias("score")]
    if columns == 9:
        out += [_at(6).cast("long").alias("thickStart"), _at(7).cast("long").alias("thickEnd"), _at(8).alias("itemRgb")]
    return f.select(*out)


def write_text(df: DataFrame, value: Column, path: str, compress: bool = False, order: list[str] | None = None) -> None:
    """One line a row, sorted over the files by ``order`` if given."""
    if order:
        df = df.orderBy(*order)
    df.select(value.alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_bed(ranges: DataFrame, path: str, columns: int = 3, compress: bool = False) -> None:
    """BED6 needs name and score; BED9 fills thickStart, thickEnd and itemRgb."""
    have = dict(ranges.dtypes)
    if columns >= 6 and (have.get("name") != "string" or have.get("score") not in ("bigint", "int")):
        raise ValueError("BED6 and BED9 need a name (string) and a score (integer)")
    out = [F.col("seqname"), F.col("start"), F.col("end")]
    if columns >= 6:
        out += [F.col("name"), F.col("score"), F.col("strand")]
    if columns == 9:
        out += [F.col(c) if c in have else d for c, d in (("thickStart", F.col("start")), ("thickEnd", F.col("end")), ("itemRgb", F.lit("0,0,0")))]
    write_text(ranges, F.concat_ws("\t", *out), path, compress, ["row_id"] if "row_id" in have else None)


# Tables ---------------------------------------------------------------------

TYPES = {"String": "string", "Int": "long", "Float": "double", "Vec<String>": "array<string>", "Vec<Int>": "array<long>", "Vec<Float>": "array<double>"}


def _cell(c: Column, kind: str) -> Column:
    base = kind.removeprefix("Vec<").removesuffix(">")
    one = {"String": lambda x: x, "Int": lambda x: x.cast("long"), "Float": lambda x: clean(F.when(x.isin("NA", "NaN"), F.lit(None)).otherwise(x).cast("double"))}[base]
    if not kind.startswith("Vec<"):
        return one(c)
    return F.when(c == "nil", F.array().cast(TYPES[kind])).otherwise(F.transform(F.split(c, ","), one))


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None, ranges: bool = True) -> DataFrame:
    """A table with a header line. Undeclared columns are left out, declared but missing ones too.

    Without ``types`` every column besides the coordinates is a list of strings.
    """
    # the header is the first line of the first file that has one; a scan begins with the largest file
    first = next((r for f in sorted(spark.read.text(path).inputFiles()) for r in spark.read.text(f).limit(1).collect()), None)
    if not first:
        raise ValueError("table has no header")
    header = [h for h in first.value.split()]
    at = {}
    for i, h in enumerate(h for h in header if h != "|"):
        at.setdefault(h, i)
    place = lambda *names: next((at[n] for n in names if n in at), None)
    body = lines(spark, path).where(F.trim("value") != F.lit(first.value.strip()))
    # the bar stands between coordinates and metadata
    f = body.withColumn("_f", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "|"))
    out = []
    if ranges:
        s, a, b, st = place("seqnames", "seqname"), place("from", "start"), place("to", "end"), place("strand")
        if None in (s, a, b):
            raise ValueError("table needs seqnames, from and to")
        out = [_at(s).alias("seqname"), _at(a).cast("long").alias("start"), _at(b).cast("long").alias("end"), (F.lit("*") if st is None else F.substring(_at(st), 1, 1)).alias("strand")]
    coords = {"seqnames", "seqname", "from", "start", "to", "end", "strand"} if ranges else set()
    wanted = types if types is not None else {h: "Vec<String>" for h in at if h not in coords}
    out += [_cell(_at(at[n]), k).alias(n) for n, k in wanted.items() if n in at]
    return f.select(*out, F.col("line").alias("row_id"))


def _shown(name: str, kind: str, scientific: bool) -> Column:
    c = F.col(f"`{name}`")
    number = (lambda x: F.format_string("%e", x)) if scientific else (lambda x: F.regexp_replace(F.format_string("%f", x), r"(\.\d*?)0+$", "$1").cast("string"))
    one = (lambda x: F.when(x.isNull(), "NaN").otherwise(number(x))) if "double" in kind else (lambda x: x.cast("string"))
    if kind.startswith("array"):
        return F.when(F.size(c) == 0, "nil").otherwise(F.array_join(F.transform(c, one), ","))
    if kind.startswith("struct"):
        return F.concat(c["from"], F.lit("-"), c["to"])
    return F.coalesce(one(c), F.lit("NA"))


def write_table_text(df: DataFrame, path: str, scientific: bool = False, strand: bool = True, compress: bool = False) -> None:
    """An aligned table: every column as wide as its widest cell, metadata behind a bar."""
    kinds = dict(df.dtypes)
    coords = [c for c in ("seqname", "start", "end", "strand") if c in kinds and (c != "strand" or strand)]
    meta = [c for c in kinds if c not in ("seqname", "start", "end", "strand", "row_id")]
    titles = {"seqname": "seqnames", "start": "from", "end": "to"}
    cells = df.select(*(["row_id"] if "row_id" in kinds else []), *[_shown(c, kinds[c], scientific).alias(f"_{i}") for i, c in enumerate(coords + meta)])
    n = len(coords + meta)
    wide = cells.agg(*[F.max(F.length(f"_{i}")).alias(f"_{i}") for i in range(n)]).first()  # one row
    names = [titles.get(c, c) for c in coords + meta]
    width = [max(len(names[i]), wide[i] or 0) for i in range(n)]
    bar = [len(coords)] if coords and meta else []
    parts, head = [], []
    for i in range(n):
        if i in bar:
            parts.append(F.lit("|"))
            head.append("|")
        parts.append(F.lpad(F.col(f"_{i}"), width[i], " "))
        head.append(names[i].rjust(width[i]))
    spark = df.sparkSession
    top = spark.createDataFrame([(" ".join(head), -1)], "value string, _o long")
    order = F.col("row_id").cast("long") if "row_id" in kinds else F.monotonically_increasing_id()
    body = cells.select(F.concat_ws(" ", *parts).alias("value"), order.alias("_o"))
    write_text(top.unionByName(body), F.col("value"), path, compress, ["_o"])


# GTF ------------------------------------------------------------------------


def read_gtf(spark: SparkSession, path: str, attributes: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """GTF as intervals, coordinates as they stand. Attributes are typed str, int or float; a missing one without a default is an error."""
    body = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    tokens = F.regexp_extract_all("value", F.lit(r'"[^"]*"|[^\t ;]+'), F.lit(0))
    f = body.withColumn("_f", F.transform(tokens, lambda t: F.regexp_replace(t, '^"|"$', "")))
    f = f.withColumn("_f", F.coalesce(_need(8, "GTF").cast("array<string>"), "_f"))
    rest = F.slice("_f", 9, F.greatest(F.size("_f") - 8, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(rest) / 2) - 1), lambda i: F.struct(F.get(rest, (2 * i).cast("int")).alias("k"), F.get(rest, (2 * i + 1).cast("int")).alias("v")))
    f = f.withColumn("_p", F.when(F.size(rest) >= 2, pairs).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
    optional = lambda i, kind: F.when(_at(i) != ".", _at(i).cast(kind))
    out = [_at(0).alias("seqname"), _at(3).cast("long").alias("start"), _at(4).cast("long").alias("end"), F.substring(_at(6), 1, 1).alias("strand"), F.col("line").alias("row_id"), _at(1).alias("source"), _at(2).alias("feature"), optional(5, "double").alias("score"), optional(7, "long").alias("frame")]
    for name, kind in (attributes or {}).items():
        got = F.get(_named("_p", name), 0)["v"]
        default = (defaults or {}).get(name)
        missing = F.raise_error(F.lit(f"attribute {name} is missing")).cast("string") if default is None else F.lit(str(default))
        out.append(F.coalesce(got, missing).cast({"str": "string", "int": "long", "float": "double"}[kind]).alias(name))
    return f.select(*out)


def _named(column: str, name: str) -> Column:
    return F.filter(column, lambda p: p["k"] == name)


def write_gtf(ranges: DataFrame, path: str, compress: bool = False) -> None:
    """GTF needs source and feature; all further columns become attributes."""
    have = dict(ranges.dtypes)
    if not {"source", "feature"} <= have.keys():
        raise ValueError("GTF needs source and feature")
    if any(k.startswith("struct") for k in have.values()):
        raise ValueError("GTF holds no ranges")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in have else F.lit(".")
    fixed = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "row_id"]
    attrs = [F.concat(F.lit(f'{c} "'), F.col(c).cast("string"), F.lit('";')) for c in have if c not in fixed]
    body = F.concat_ws("\t", "seqname", "source", "feature", F.col("start"), F.col("end"), dot("score"), "strand", dot("frame"), F.concat_ws(" ", *attrs))
    write_text(ranges, body, path, compress, ["row_id"] if "row_id" in have else None)


# Signals --------------------------------------------------------------------


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Intervals with ``values``; blank lines are left out, others have exactly four fields."""
    f = _split(lines(spark, path).where(F.trim("value") != ""), 4, "bedGraph")
    bad = F.when(F.size("_f") != 4, F.raise_error("bedGraph has four fields"))
    return f.select(F.coalesce(bad.cast("string"), _at(0)).alias("seqname"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), F.lit("*").alias("strand"), F.col("line").alias("row_id"), clean(_at(3).cast("double")).alias("values"))


def bedgraph_bins(rows: DataFrame, bin_size: int) -> DataFrame:
    """(seqname, bin, value) of bedGraph rows; the last line of a bin counts."""
    each = rows.where(F.floor(F.col("end") / bin_size) > F.floor(F.col("start") / bin_size)).select("seqname", "row_id", "values", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size) - 1)).alias("bin"))
    return each.groupBy("seqname", "bin").agg(F.max_by("values", "row_id").alias("value"))


def write_bedgraph(ranges: DataFrame, path: str, compress: bool = False) -> None:
    if dict(ranges.dtypes).get("values") != "double":
        raise ValueError("bedGraph needs values (double)")
    v = F.coalesce(F.col("values").cast("string"), F.lit("NaN"))
    write_text(ranges, F.concat_ws("\t", "seqname", F.col("start"), F.col("end"), v), path, compress, ["row_id"] if "row_id" in ranges.columns else None)


def read_wiggle(spark: SparkSession, path: str, bin_size: int) -> DataFrame:
    """(seqname, bin, value) of fixedStep and variableStep blocks; a file is read in one task, as its declarations ask."""
    import pandas as pd

    def parse(frames):
        for frame in frames:
            rows = []
            for content in frame["content"]:
                kind, chrom, at, step = None, None, 0, 0
                for line in bytes(content).decode().splitlines():
                    token = line.split()
                    if not token or token[0] in ("track", "browser") or line.startswith("#"):
                        continue
                    if token[0] in ("fixedStep", "variableStep"):
                        d = dict(t.split("=", 1) for t in token[1:])
                        kind, chrom = token[0], d["chrom"]
                        at, step = int(d.get("start", 1)) - 1, int(d.get("step", 1))
                        span = int(d.get("span", step if kind == "fixedStep" else 1))
                        if bin_size not in (span, step):
                            raise ValueError(f"step or span differs from the bin size {bin_size}")
                    elif kind == "fixedStep":
                        rows.append((chrom, at // bin_size, float(token[0])))
                        at += step
                    elif kind == "variableStep":
                        rows.append((chrom, (int(token[0]) - 1) // bin_size, float(token[1])))
                    else:
                        raise ValueError("values before a declaration")
            yield pd.DataFrame(rows, columns=["seqname", "bin", "value"])

    import gzip

    def unzipped(frames):
        for f in frames:
            yield f.assign(content=[gzip.decompress(c) if bytes(c[:2]) == b"\x1f\x8b" else c for c in f["content"]])

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInPandas(lambda fs: parse(unzipped(fs)), "seqname string, bin long, value double")
    return out.withColumn("value", clean(F.col("value")))


def write_wiggle(rows: DataFrame, path: str, bin_size: int, name: str = "", compress: bool = False) -> None:
    """A block for each sequence: variableStep where half of the bins or more are missing or zero, else fixedStep."""
    from pyspark.sql import Window

    w = Window.partitionBy("seqname")
    empty = F.col("value").isNull() | (F.col("value") == 0)
    n = rows.withColumn("_sparse", F.count_if(empty).over(w) * 2 >= F.count("*").over(w))
    first = rows.groupBy("seqname").agg(F.min("bin").alias("bin"))
    sparse = n.where("_sparse").select("seqname").distinct().withColumn("_sparse", F.lit(True))
    heads = first.join(sparse, "seqname", "left").select(
        "seqname", F.lit(-1).cast("long").alias("bin"),
        F.when(F.coalesce("_sparse", F.lit(False)), F.concat(F.lit("variableStep chrom="), "seqname", F.lit(f" span={bin_size}"))).otherwise(F.concat(F.lit("fixedStep chrom="), "seqname", F.lit(f" start=1 span={bin_size} step={bin_size}"))).alias("value"),
    )
    shown = F.coalesce(F.col("value").cast("string"), F.lit("NaN"))
    body = n.where(~(F.col("_sparse") & empty)).select("seqname", "bin", F.when(F.col("_sparse"), F.concat_ws(" ", F.col("bin") * bin_size + 1, shown)).otherwise(shown).alias("value"))
    top = rows.sparkSession.createDataFrame([("", -2, f'track type=wiggle_0 name="{name}"')], "seqname string, bin long, value string")
    write_text(top.unionByName(heads).unionByName(body), F.col("value"), path, compress, ["seqname", "bin"])


# Sequences ------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """(ord, name, sequence); ``ordered`` refuses names that occur twice."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    head = F.regexp_extract("value", r"^[^\n\r]*", 0)
    out = raw.select("ord", F.regexp_extract(head, r"[^\s|]+", 0).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n\r]*", ""), r"\s", "").alias("sequence"))
    if ordered and out.groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("a name occurs twice")
    return out


def write_fasta(sequences: DataFrame, path: str, compress: bool = False) -> None:
    body = F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(F.regexp_replace("sequence", "(.{80})", "$1\n"), r"\n$", ""))
    write_text(sequences, body, path, compress, ["ord"] if "ord" in sequences.columns else None)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): the lines of text files with their number in the file, from 0, in order within each task.

    Lines are counted for each split of a file first; a table of one row a split
    then says where each begins.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = own.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    begins = splits.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "split", "first", "before")
    # one row for each split of spark.sql.files.maxPartitionBytes
    met = own.join(F.broadcast(begins), ["file", "split"])
    return met.select("value", "file", (F.col("before") + F.col("id") - F.col("first")).alias("line"))


def _record(lines: list[str], at: int) -> tuple[str, str, str, int]:
    if len(lines) < 4 or lines[0][:1] != "@" or lines[2][:1] != "+" or len(lines[1]) != len(lines[3]):
        raise ValueError(f"bad FASTQ record at line {at + 1}")
    return lines[0][1:], lines[1], lines[3], at


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, qualities, line) of strict four-line records; a plain file is read in splits.

    A task puts together the records that lie in its split; the lines of records
    that two splits share are gathered by record.
    """
    import pandas as pd

    schema = "header string, sequence string, qualities string, line long"

    def run(frames):
        file, held, at = None, [], 0

        def rest():
            return [(file, at + i, x) for i, x in enumerate(held)]

        for f in frames:
            whole, parts = [], []
            for value, name, line in zip(f["value"].tolist(), f["file"].tolist(), f["line"].tolist(), strict=True):
                if held and (name != file or line != at + len(held)):
                    parts += rest()
                    held = []
                if not held:
                    file, at = name, line
                held.append(value)
                if line % 4 == 3:
                    if len(held) == 4:
                        whole.append(_record(held, at))
                    else:
                        parts += rest()
                    held = []
            yield pd.DataFrame(whole, columns=["header", "sequence", "qualities", "line"]).assign(file=None, value=None)
            yield pd.DataFrame(parts, columns=["file", "line", "value"]).assign(header=None, sequence=None, qualities=None)
        yield pd.DataFrame(rest(), columns=["file", "line", "value"]).assign(header=None, sequence=None, qualities=None)

    def gathered(key, frame):
        frame = frame.sort_values("line")
        at = 4 * int(key[1])
        if frame["line"].tolist() != list(range(at, at + 4)):
            raise ValueError(f"bad FASTQ record at line {at + 1}")
        return pd.DataFrame([_record(frame["value"].tolist(), at)], columns=["header", "sequence", "qualities", "line"])

    # written, as the file would be read and put together once for each part else
    each, _ = write_table(numbered_lines(spark, path).mapInPandas(run, schema + ", file string, value string"), "fastq")
    parts = each.where("file is not null").groupBy("file", F.expr("line div 4")).applyInPandas(gathered, schema)
    return each.where("file is null").select("header", "sequence", "qualities", "line").unionByName(parts)


def write_fastq(records: DataFrame, path: str, compress: bool = False) -> None:
    write_text(records, F.concat(F.lit("@"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), "qualities"), path, compress, ["line"] if "line" in records.columns else None)


# Small tables ---------------------------------------------------------------


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    f = _split(lines(spark, path).where(F.trim("value") != ""), 2, "genome")
    return f.select(_at(0).alias("seqname"), _at(1).cast("long").alias("length"), F.col("line").alias("ord"))


def write_genome(genome: DataFrame, path: str) -> None:
    write_text(genome, F.concat_ws("\t", "seqname", F.col("length")), path, order=["ord"] if "ord" in genome.columns else None)


def read_ucsc_genes(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns: name, sequence, strand, transcription start and end, coding start and end."""
    return ucsc_genes(_split(lines(spark, path), 7, "gene table").select(*[_at(i).alias(n) for i, n in enumerate(("name", "chrom", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd"))], "line"))


def ucsc_genes(rows: DataFrame) -> DataFrame:
    """Genes from a UCSC table, read from a file or by ``spark.read.jdbc``."""
    n = lambda c: F.col(c).cast("long")
    row_id = F.col("line") if "line" in rows.columns else F.monotonically_increasing_id()
    return rows.select(row_id.alias("row_id"), F.col("name").alias("names"), F.col("chrom").alias("seqname"), n("txStart").alias("start"), n("txEnd").alias("end"), "strand", F.struct(n("cdsStart").alias("from"), n("cdsEnd").alias("to")).alias("cds"))


CPG = ("length", "cpgNum", "gcNum", "perCpg", "perGc", "obsExp")


def read_cpg_islands(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns: the interval, three counts, three shares."""
    f = _split(lines(spark, path), 9, "CpG islands")
    return f.select(_at(0).alias("seqname"), _at(1).cast("long").alias("start"), _at(2).cast("long").alias("end"), F.lit("*").alias("strand"), F.col("line").alias("row_id"), *[_at(3 + i).cast("long" if i < 3 else "double").alias(c) for i, c in enumerate(CPG)])


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of a tab-separated report: comments and the header line are left out, and the end is moved past the last base."""
    body = lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("chr\tstart"))
    f = _split(body, 9, "peaks")
    return f.select(
        _at(0).alias("seqname"), _at(1).cast("long").alias("start"), (_at(2).cast("long") + 1).alias("end"), F.lit("*").alias("strand"), F.col("line").alias("row_id"),
        _at(4).cast("long").alias("abs_summit"), _at(5).cast("double").alias("pileup"), _at(6).cast("double").alias("-log10(pvalue)"), _at(7).cast("double").alias("fold_enrichment"), _at(8).cast("double").alias("-log10(qvalue)"),
    )


def read_fpkm(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, fpkm) of a 13-column tracking file's rows with status OK."""
    f = _split(lines(spark, path), 13, "tracking file").where(_at(0) != "tracking_id")
    return f.where(_at(12) == "OK").select(_at(3).alias("gene_id"), _at(9).cast("double").alias("fpkm"))


def read_chromhmm(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, bin, state, value) of a posterior table: cell and sequence, the states, a row a bin; a file in one task."""
    import pandas as pd

    def parse(frames):
        for frame in frames:
            rows = []
            for content in frame["content"]:
                text = bytes(content).decode().splitlines()
                seqname, states = text[0].split()[1], text[1].split()
                rows += [(seqname, i, s, float(v)) for i, line in enumerate(text[2:]) for s, v in zip(states, line.split(), strict=True)]
            yield pd.DataFrame(rows, columns=["seqname", "bin", "state", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "seqname string, bin long, state string, value double")


def show(df: DataFrame, n: int = 10) -> str:
    """All rows of up to ``n`` + 1, else the first and last half with a gap between, by row_id."""
    total = df.count()
    if total <= n + 1:
        return df.orderBy("row_id").toPandas().to_string(index=False)
    head, tail = df.orderBy("row_id").limit(n // 2).toPandas(), df.orderBy(F.desc("row_id")).limit(n - n // 2).toPandas()[::-1]
    return "\n".join([head.to_string(index=False), "...", tail.to_string(index=False, header=False)])
