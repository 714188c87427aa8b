"""Writers of the text formats.

Each writes a folder of parts, in the order of the rows; an existing folder is
an error (SK15).  ``as_one`` is for small reports only: it writes one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hapmap import iht_text


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None, as_one: bool = False) -> None:
    """Write a DataFrame of one text column; the header lines come first, in a part of their own unless ``as_one``."""
    own = lines.toDF("value")
    if as_one:
        own = own.coalesce(1)
    if header:
        head = lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        own = head.unionByName(own)
        own = own.coalesce(1) if as_one else own
    own.write.mode("errorifexists").text(path)


def write_ordered(lines: DataFrame, path: str, header: list[str] | None = None, parts: int | None = None) -> None:
    """Write tab-separated lines in the order of their first two fields, chromosome and position, with an index (SK1, SK4, SK7).

    Rows are dealt out by ranges, so the parts are in order one after the other
    and each is sorted; the header is the first part alone.  ``_index`` below the
    folder, which readers of the folder pass over, has for each part and
    chromosome the first and the last position and the number of lines.
    """
    spark = lines.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = F.split("value", "\t")
    keyed = lines.toDF("value").withColumns({"chrom": F.get(f, 0), "pos": F.get(f, 1).try_cast("long")})
    own = keyed.repartitionByRange(n, "chrom", "pos").sortWithinPartitions("chrom", "pos", "value").select("value")
    if header:
        own = spark.createDataFrame([(i, h) for i, h in enumerate(header)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").unionByName(own)
    own.write.mode("errorifexists").text(path)
    written = spark.read.text(path).where("not startswith(value, '#')")
    places = written.select(F.col("_metadata.file_name").alias("part"), F.get(f, 0).alias("chrom"), F.get(f, 1).try_cast("long").alias("pos"))
    index = places.groupBy("part", "chrom").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("lines"))
    index.coalesce(1).write.parquet(f"{path}/_index")


def read_ordered(spark, path: str, chrom: str, first: int, last: int) -> DataFrame:
    """Lines of ``write_ordered`` whose positions lie in a region, both ends in; only the parts that the index names are read."""
    index = spark.read.parquet(f"{path}/_index")
    parts = [r["part"] for r in index.where((F.col("chrom") == chrom) & (F.col("first") <= last) & (F.col("last") >= first)).select("part").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], "value string")
    f = F.split("value", "\t")
    return spark.read.text([f"{path}/{p}" for p in parts]).where((F.get(f, 0) == chrom) & F.get(f, 1).try_cast("long").between(first, last))


def bed_lines(df: DataFrame, *more: str) -> DataFrame:
    """Tab-separated chrom, s, e and more columns (SK7)."""
    return df.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in more]))


def vcf_lines(records: DataFrame, samples: list[str]) -> DataFrame:
    """Lines of records as ``read_vcf`` gives them (SK4, SK10 to SK12); GT, DP and GQ of the calls are written."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    text = lambda a, sep: F.when(F.size(a) > 0, F.array_join(a, sep)).otherwise(".")
    info = F.array_join(F.sort_array(F.transform(F.map_entries("info"), lambda x: F.when(x["value"] == "true", x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"])))), ";")

    def call(name: str) -> Column:
        c = F.get(F.filter("calls", lambda x: x["sample"] == name), 0)
        alleles = F.transform(c["gt"], dot)
        gt = F.when(c["phased"], F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))
        return F.concat_ws(":", F.coalesce(gt, F.lit("./.")), dot(c["dp"]), dot(c["gq"]))

    return records.select(
        F.concat_ws("\t", "chrom", (F.col("pos0") + 1).cast("string"), dot(F.col("id")), "ref", text(F.col("alts"), ","), dot(F.col("qual")), text(F.col("filters"), ";"), F.coalesce(F.nullif(info, F.lit("")), F.lit(".")), F.lit("GT:DP:GQ"), *[call(s) for s in samples])
    )


def merged_sv_lines(primaries: DataFrame, links: DataFrame, calls: DataFrame) -> DataFrame:
    """VCF lines of merged structural variants with their support: SUPPORT, the supporting ids, and N_SOURCES (SK11)."""
    support = links.groupBy(F.col("primary_id").alias("id")).agg(F.sort_array(F.collect_set("support_id")).alias("ids"), F.collect_set("round").alias("rounds"))
    own = primaries.select("id").join(calls, "id").join(support, "id", "left")
    info = F.create_map(
        F.lit("SVTYPE"), F.col("svtype"), F.lit("SVLEN"), F.col("svlen").cast("string"), F.lit("END"), F.col("end_pos").cast("string"),
        F.lit("SUPPORT"), F.coalesce(F.array_join("ids", ","), F.lit(".")), F.lit("N_SOURCES"), (1 + F.coalesce(F.size("rounds"), F.lit(0))).cast("string"),
    )
    records = own.select(
        "chrom", F.col("start_pos").alias("pos0"), "id", F.lit("N").alias("ref"), F.array(F.concat(F.lit("<"), "svtype", F.lit(">"))).alias("alts"), F.lit(None).cast("double").alias("qual"),
        F.array(F.lit("PASS")).alias("filters"), info.alias("info"), F.array(F.struct(F.lit("").alias("sample"), F.array(F.lit(None).cast("int")).alias("gt"), F.lit(False).alias("phased"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("int").alias("gq"))).alias("calls"),
    )
    return vcf_lines(records, [])


def vcf_header(samples: list[str], contigs: list[tuple[str, int]] = ()) -> list[str]:
    """Header lines of a VCF."""
    return ["##fileformat=VCFv4.2", *[f"##contig=<ID={c},length={n}>" for c, n in contigs], "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def split_by_status(decided: DataFrame, path: str, lines, header: list[str] | None = None) -> None:
    """Two ordered folders, ``pass`` and ``fail``, of one decided table (SK4); ``lines`` makes text of rows."""
    for name in ("pass", "fail"):
        write_ordered(lines(decided.where(F.col("status") == name)), f"{path}/{name}", header)


def iht_lines(labels: DataFrame, people: list[str], founders: list[str]) -> DataFrame:
    """Lines of a haplotype map: chrom, start, end, labels of ``people``, marker count, length, letters that occur beside the founders' own (SK1).

    ``labels`` has chrom, start_pos, end_pos, n_markers, id, h0, h1.
    """
    own = labels.withColumn("x", iht_text(F.col("h0"), F.col("h1"), F.col("id").isin(founders)))
    wide = own.groupBy("chrom", "start_pos", "end_pos", "n_markers").pivot("id", people).agg(F.max("x"))
    text = [F.coalesce(F.col(p), F.lit("?|?")) for p in people]
    size = (F.col("end_pos") - F.col("start_pos")).cast("string")
    letters = F.split(F.concat_ws("", *[t for p, t in zip(people, text) if p not in founders]), "")
    occur = F.array_join(F.sort_array(F.array_distinct(F.filter(letters, lambda x: x.rlike("^[A-Z]$")))), ",")
    return wide.select(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), *text, F.col("n_markers").cast("string"), size, occur))


def marker_lines(labels: DataFrame, people: list[str]) -> DataFrame:
    """Lines of markers with ``label:child,child;...`` in order (SK2): labels has chrom, pos0, id, slot, label."""
    lists = labels.where("label is not null and label <> '.'").groupBy("chrom", "pos0", "label").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids"))
    info = lists.groupBy("chrom", "pos0").agg(F.array_join(F.sort_array(F.collect_list(F.concat("label", F.lit(":"), "ids"))), ";").alias("info"))
    pairs = labels.groupBy("chrom", "pos0").pivot("id", people).agg(F.concat_ws("|", F.coalesce(F.max(F.when(F.col("slot") == 0, F.col("label"))), F.lit("?")), F.coalesce(F.max(F.when(F.col("slot") == 1, F.col("label"))), F.lit("?"))))
    return pairs.join(info, ["chrom", "pos0"]).select(F.concat_ws("\t", "chrom", F.col("pos0").cast("string"), *[F.coalesce(F.col(p), F.lit("?|?")) for p in people], "info"))


def switch_lines(switches: DataFrame) -> DataFrame:
    """Lines of recombinants (SK3)."""
    return switches.select(F.concat_ws("\t", "chrom", F.col("prev_end").cast("string"), F.col("next_start").cast("string"), "id", "old", "new"))


def fasta_lines(df: DataFrame, name: str, sequence: str) -> DataFrame:
    """FASTA records, header and sequence in one value (SK8)."""
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)))


def overlap_lines(marked: DataFrame) -> DataFrame:
    """Lines of overlapping variants: chrom, start from 1, ref, alt, kind of overlap, idx, hap (SK8); ``marked`` is that of ``haplograph.overlaps``."""
    return marked.where("overlap <> 'NoOvl'").select(F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), "ref", "alt", "overlap", F.col("idx").cast("string"), F.col("hap").cast("string")))


def write_haplotypes(ways: DataFrame, sample: str, path: str) -> None:
    """``haps.fasta`` and ``variants.json`` of ways with their variants, by labels ``sample;region;hap:path`` (SK8)."""
    label = F.concat(F.lit(f"{sample};"), "region", F.lit(";hap:"), F.col("path").cast("string"))
    named = ways.withColumn("label", label)
    write_lines(fasta_lines(named.withColumn("head", F.concat("label", F.lit(" nvar:"), F.col("n_variants").cast("string"))), "head", "haplotype"), f"{path}/haps.fasta")
    write_lines(json_lines(named.select("label", F.col("n_variants").alias("count"), F.col("variants").alias("vars"))), f"{path}/variants.json")


def subset_repeats(spark, path: str, keep: DataFrame, out: str) -> None:
    """The header of a repeat VCF and its lines whose TRID ``keep`` (trid) has, as they are (SK14, J14)."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.where("value like '##%' or value like '#CHROM%'").collect()]
    trid = F.replace(F.split(F.split("value", r"\s+")[7], ";")[0], F.lit("TRID="), F.lit(""))
    own = lines.where("value not like '#%'").withColumn("trid", trid).join(keep.select("trid").distinct(), "trid", "left_semi")
    write_lines(own.select("value"), out, sorted(head, key=lambda h: not h.startswith("##")))


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object (SK8, SK9)."""
    return df.select(F.to_json(F.struct(*df.columns)))


def csv_folder(df: DataFrame, path: str, separator: str = ",") -> None:
    """A table with a header (SK13, SK14)."""
    df.write.mode("errorifexists").option("header", True).option("sep", separator).csv(path)
