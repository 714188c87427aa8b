"""Readers of the usual text formats as DataFrames.

All read through Spark's text source, so paths may be folders, globs, gzip files
or any file system that Spark knows.  Lines that can't be parsed are dropped, as
a bad line doesn't stop a run; ``rejected`` shows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import running


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _long(c: Column) -> Column:
    return c.try_cast("long")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, s, e and ``rest``, the other fields (SC1)."""
    parts = _lines(spark, path).where("not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("f"))
    typed = parts.select(F.get("f", 0).alias("chrom"), _long(F.get("f", 1)).alias("s"), _long(F.get("f", 2)).alias("e"), F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))).alias("rest"))
    return typed.where("s is not null and e is not null")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """BED lines that ``read_bed`` drops."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where("not startswith(value, '#')").where(_long(F.get(f, 1)).isNull() | _long(F.get(f, 2)).isNull())


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """family, id, father, mother, sex, phenotype (SC2, SC3); NA and 0 are no parent, lines under six fields are dropped."""
    f = _lines(spark, path).where("not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 6")
    parent = lambda k: F.when(F.get("f", k).isin("NA", "0"), None).otherwise(F.get("f", k))
    return f.select(F.get("f", 0).alias("family"), F.get("f", 1).alias("id"), parent(2).alias("father"), parent(3).alias("mother"), F.get("f", 4).try_cast("int").alias("sex"), F.get("f", 5).try_cast("int").alias("phenotype"))


def read_ped_with_header(spark: SparkSession, path: str) -> DataFrame:
    """The dialect with a header and sex in words: family, id, father, mother, sex."""
    f = _lines(spark, path).where("not startswith(value, '#')").select(F.split(F.trim("value"), r"\t|\s+").alias("f")).where("size(f) >= 5")
    parent = lambda k: F.when(F.get("f", k).isin("NA", "0"), None).otherwise(F.get("f", k))
    sex = F.when(F.lower(F.get("f", 4)) == "male", 1).when(F.lower(F.get("f", 4)) == "female", 2)
    return f.select(F.get("f", 0).alias("family"), F.get("f", 1).alias("id"), parent(2).alias("father"), parent(3).alias("mother"), sex.alias("sex"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of a VCF's header line (SC8); one line is read."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return head["value"].split("\t")[9:] if head else []


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of the header's contig lines (SC8)."""
    lines = spark.read.text(path).where(F.col("value").startswith("##contig="))
    return lines.select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract("value", "length=([0-9]+)", 1).try_cast("long").alias("length"))


def read_vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """Records of a VCF (SC4, SC6): chrom, pos0, id, ref, alts, qual, filters, info, calls.

    ``calls`` is array<(sample, gt, phased, dp, gq, ad, sd)> in header order; missing
    values are null.  ``samples`` keeps some samples only.
    """
    names = vcf_samples(spark, path)
    wanted = [k for k, n in enumerate(names) if samples is None or n in samples]
    fields = _lines(spark, path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    dot = lambda c: F.nullif(F.nullif(c, F.lit(".")), F.lit(""))
    # each text is split once, in a column of its own: an expression that names it again would split it again
    entries = F.transform(F.split(F.get("f", 7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.alias("x")))
    keys = F.split(F.get("f", 8), ":")
    place = {key: (F.array_position(keys, F.lit(key)) - 1).cast("int").alias(f"_{key}") for key in ("GT", "DP", "GQ", "AD", "SD")}
    parted = fields.select("f", entries.alias("_info"), *(place.values() if wanted else []), *[F.split(F.get("f", 9 + k), ":").alias(f"_{k}") for k in wanted])
    # of a repeated key the first counts: a map can't hold two
    names_only = F.col("_info.k")
    first = F.when(F.size(F.array_distinct(names_only)) == F.size(names_only), F.col("_info")).otherwise(F.filter("_info", lambda x, i: F.array_position(names_only, x["k"]) == i + 1))
    pairs = F.transform(first, lambda x: F.struct(x["k"].alias("k"), F.when(F.length(x["k"]) == F.length(x["x"]), F.lit("true")).otherwise(F.substr(x["x"], F.length(x["k"]) + 2)).alias("v")))

    def call(k: int) -> Column:
        value = lambda key: dot(F.get(f"_{k}", F.col(f"_{key}")))
        numbers = lambda key: F.transform(F.split(value(key), ","), lambda x: x.try_cast("int"))
        gt = F.coalesce(F.get(f"_{k}", F.col("_GT")), F.lit("./."))
        return F.struct(
            F.lit(names[k]).alias("sample"), F.transform(F.split(F.translate(gt, "|", "/"), "/"), lambda x: x.try_cast("int")).alias("gt"), F.contains(gt, F.lit("|")).alias("phased"),
            value("DP").try_cast("int").alias("dp"), value("GQ").try_cast("int").alias("gq"), numbers("AD").alias("ad"), numbers("SD").alias("sd"),
        )

    calls = F.array(*[call(k) for k in wanted]) if wanted else F.array()
    return parted.where("size(f) >= 8 and try_cast(f[1] as long) is not null").select(
        F.get("f", 0).alias("chrom"), (_long(F.get("f", 1)) - 1).alias("pos0"), dot(F.get("f", 2)).alias("id"), F.get("f", 3).alias("ref"),
        F.filter(F.split(F.get("f", 4), ","), lambda a: a != ".").alias("alts"), dot(F.get("f", 5)).try_cast("double").alias("qual"),
        F.filter(F.split(F.get("f", 6), ";"), lambda x: x != ".").alias("filters"), F.map_from_entries(pairs).alias("info"), calls.alias("calls"),
    )


RANGE = 1 << 22


def store_records(records: DataFrame, path: str, size: int = RANGE, parts: int | None = None) -> None:
    """Write records of ``read_vcf`` by chromosome and range of positions, sorted by position inside (SC7).

    This takes the place of an index: regions read only the folders of their
    ranges, and in these the row groups whose positions and qualities can match.
    """
    placed = records.withColumn("range", F.expr(f"pos0 div {size}"))
    spread = placed.repartition(*([parts] if parts else []), "chrom", "range").sortWithinPartitions("chrom", "range", "pos0")
    spread.write.mode("errorifexists").option("parquet.block.size", 8 << 20).partitionBy("chrom", "range").parquet(path)


def read_region(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], min_qual: float | None = None, size: int = RANGE, longest: int = 0) -> DataFrame:
    """Records of ``store_records`` in one of the ``regions`` (chrom, first, last position, both in), without those of low quality (SC4, SC5).

    A record belongs to a region by its position, or, with ``longest`` the
    greatest length of a reference allele, by any of its bases.
    """
    stored = spark.read.parquet(path)
    here: Column = F.lit(False)
    for chrom, first, last in regions:
        start = max(0, first - max(0, longest - 1))
        own = (F.col("chrom") == chrom) & F.col("range").between(start // size, last // size) & F.col("pos0").between(start, last)
        here = here | (own & (F.col("pos0") + F.length("ref") > first) if longest else own)
    found = stored.where(here)
    if min_qual is not None:
        found = found.where(F.col("qual").isNull() | F.isnan("qual") | (F.col("qual") >= min_qual))
    return found.drop("range")


def genotypes(records: DataFrame) -> DataFrame:
    """Records' calls as rows: chrom, pos0, ref, alts, qual, sample, gt, phased, dp, gq, ad."""
    # a slice of all: of a plain column Spark infers a filter, which parses all calls once more below
    each = F.explode(F.slice("calls", F.lit(1), F.size("calls"))).alias("c")
    return records.select("chrom", "pos0", "ref", "alts", "qual", each).select("chrom", "pos0", "ref", "alts", "qual", "c.*")


def read_inheritance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inheritance blocks of the wide CSV in long form: b, chrom, start_pos, end_pos, id, ord, h0, h1 (SC10).

    A block with a label of one letter is left out as a whole.
    """
    wide = spark.read.csv(path, header=True)
    wide = wide.select([F.col(f"`{c}`").alias(c.replace("﻿", "")) for c in wide.columns])
    chrom, start, end, *people = wide.columns
    rows = wide.select(F.monotonically_increasing_id().alias("b"), F.col(chrom).alias("chrom"), _long(F.col(start)).alias("start_pos"), _long(F.col(end)).alias("end_pos"), *people)
    whole = rows.where(F.forall(F.array(*people), lambda x: F.coalesce(F.length(x) == 2, F.lit(False))))
    each = F.posexplode(F.array(*[F.struct(F.lit(p).alias("id"), F.col(p).alias("x")) for p in people])).alias("ord", "p")
    return whole.select("b", "chrom", "start_pos", "end_pos", each).select("b", "chrom", "start_pos", "end_pos", F.col("p.id").alias("id"), "ord", F.substr("p.x", F.lit(1), F.lit(1)).alias("h0"), F.substr("p.x", F.lit(2), F.lit(1)).alias("h1"))


def read_ivec_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same for tandem repeats: equal letters are one (SC12); column names by any case."""
    return read_inheritance_csv(spark, path).withColumn("h1", F.when(F.col("h0") == F.col("h1"), None).otherwise(F.col("h1")))


def read_iht(spark: SparkSession, path: str) -> DataFrame:
    """A haplotype map in long form: chrom, start_pos, end_pos, n_markers, id, founder, h0, h1 (SC11); unknown labels are null.

    Founders' labels are parted by ``/``, others' by ``|``.  Rows with fields missing are left out.
    """
    head = spark.read.text(path).where(F.col("value").startswith("#chrom")).first()
    names = head["value"].split() if head else []
    people = names[3 : names.index("marker_count")] if "marker_count" in names else []
    f = _lines(spark, path).where("not startswith(value, '#')").select(F.split("value", r"\s+").alias("f")).where(F.size("f") >= len(names) - 1)
    label = lambda c: F.when(c == "?", None).otherwise(c)
    if not people:
        return f.select(F.get("f", 0).alias("chrom")).where("false")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("id"), F.get("f", 3 + k).alias("x")) for k, p in enumerate(people)])).alias("p")
    rows = f.select(F.get("f", 0).alias("chrom"), _long(F.get("f", 1)).alias("start_pos"), _long(F.get("f", 2)).alias("end_pos"), _long(F.get("f", 3 + len(people))).alias("n_markers"), each)
    pair = F.split("p.x", "[|/]")
    return rows.select("chrom", "start_pos", "end_pos", "n_markers", F.col("p.id").alias("id"), F.contains("p.x", F.lit("/")).alias("founder"), label(pair[0]).alias("h0"), label(pair[1]).alias("h1"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: name, block_len, edits, and the name's sample, region, hap and version (SC14)."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).select(f.alias("f"))
    nm = F.get(F.filter("f", lambda x: x.startswith("NM:i:")), 0)
    parts = F.split(F.get("f", 0), ";")
    return rows.select(F.get("f", 0).alias("name"), F.get("f", 10).try_cast("long").alias("block_len"), F.substr(nm, F.lit(6)).try_cast("long").alias("edits"), F.get(parts, 0).alias("sample"), F.get(parts, 1).alias("region"), F.get(parts, 2).alias("hap"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of a FASTA index (SC16)."""
    f = F.split("value", "\t")
    return _lines(spark, path).select(F.get(f, 0).alias("chrom"), _long(F.get(f, 1)).alias("length"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence in lower case, one row for each record (SC17); for whole chromosomes see ``read_fasta_chunks``."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    whole = F.regexp_replace("value", "^>", "")
    head = F.substring_index(whole, "\n", 1)
    body = F.regexp_replace(F.substr(whole, F.length(head) + 1), r"\s", "")
    return records.select(F.split(F.trim(head), r"\s+")[0].alias("name"), F.lower(body).alias("sequence"))


CHUNK = 1 << 16


def read_fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """chrom, chunk, sequence in lower case, read line by line (SC17): a record of any length is read by many tasks.

    A line's place in its record is the number of bases between its header and
    itself, a running sum over the splits of the file.  Lines are ordered by the
    split they come from and their order in it.  A record whose name comes again
    in another file keeps the chunks of each.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    head = F.startswith("value", F.lit(">"))
    lines = raw.withColumns({"bases": F.when(head, "").otherwise(F.lower(F.regexp_replace("value", r"\s", ""))), "name": F.when(head, F.split(F.trim(F.substr("value", F.lit(2))), r"\s+")[0])}).drop("value")
    summed = running(lines, ["file"], "split", ["line"], F.length("bases").cast("long"), "so_far", how="sum")
    header = F.when(F.col("name").isNotNull(), F.struct("split", "line", "name", "so_far"))
    placed = running(summed, ["file"], "split", ["line"], header, "head").where("bases <> '' and head is not null")
    at = F.col("so_far") - F.col("head.so_far")
    spread = placed.select("file", F.col("head.name").alias("chrom"), at.alias("at"), "bases").withColumn("chunk", F.explode(F.expr(f"sequence(at div {size}, (at + length(bases) - 1) div {size})")))
    begin = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
    piece = F.substr("bases", (begin + 1).cast("int"), (F.least((F.col("chunk") + 1) * size - F.col("at"), F.length("bases")) - begin).cast("int"))
    pieces = spread.groupBy("file", "chrom", "chunk").agg(F.sort_array(F.collect_list(F.struct("at", piece.alias("x")))).alias("pieces"))
    return pieces.select("chrom", F.col("chunk").cast("int").alias("chunk"), F.array_join(F.transform("pieces", lambda p: p["x"]), "").alias("sequence"))


def fasta_chunks(fasta: DataFrame, size: int = CHUNK) -> DataFrame:
    """chrom, chunk, sequence: records cut into chunks, a table to store once, so that regions meet chunks and no task ships a chromosome."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("sequence") - 1) / size).cast("int")))).alias("chunk")
    cut_up = fasta.select(F.col("name").alias("chrom"), "sequence", at)
    return cut_up.select("chrom", "chunk", F.substr("sequence", F.col("chunk") * size + 1, F.lit(size)).alias("sequence"))


def fasta_region(chunks: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """chrom, s, e, sequence of distinct regions, half open, from the chunks that they touch."""
    want = regions.select("chrom", "s", "e").where("s < e").distinct()
    touched = want.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size)))).withColumn("chunk", F.col("chunk").cast("int"))
    begin = F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0))
    part = F.substr("sequence", (begin + 1).cast("int"), (F.least(F.col("e") - F.col("chunk") * size, F.lit(size)) - begin).cast("int"))
    parts = touched.join(chunks, ["chrom", "chunk"]).select("chrom", "s", "e", F.struct("chunk", part.alias("x")).alias("p"))
    return parts.groupBy("chrom", "s", "e").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]), "").alias("sequence"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments in text form: name, flag, chrom, pos0, mapq, cigar, seq (SC18); unmapped records are left out."""
    f = _lines(spark, path).where("not startswith(value, '@')").select(F.split("value", "\t").alias("f")).where("size(f) >= 11")
    rows = f.select(
        F.get("f", 0).alias("name"), F.get("f", 1).try_cast("int").alias("flag"), F.get("f", 2).alias("chrom"), (_long(F.get("f", 3)) - 1).alias("pos0"),
        F.get("f", 4).try_cast("int").alias("mapq"), F.get("f", 5).alias("cigar"), F.get("f", 9).alias("seq"),
    )
    return rows.where("pos0 >= 0 and chrom <> '*' and cigar <> '*'")


def read_sv_vcf(spark: SparkSession, path: str, prio: int) -> DataFrame:
    """Structural variants of one caller: id, prio, chrom, svtype, start_pos, end_pos, svlen (SC20).

    Type and length come from INFO, else from the alleles; the end from INFO, else
    from the reference allele.
    """
    rows = read_vcf(spark, path)
    info = lambda k: F.try_element_at("info", F.lit(k))
    d = F.length(F.get("alts", 0)) - F.length("ref")
    svtype = F.coalesce(info("SVTYPE"), F.when(d > 0, "INS").when(d < 0, "DEL").otherwise("OTHER"))
    # through an array of one row, so that a filter on the type doesn't parse INFO once more below
    own = F.struct(
        "id", F.lit(prio).cast("long").alias("prio"), "chrom", svtype.alias("svtype"), F.col("pos0").alias("start_pos"),
        F.coalesce(info("END").try_cast("long"), F.col("pos0") + F.length("ref")).alias("end_pos"), F.coalesce(info("SVLEN").try_cast("long"), d.cast("long")).alias("svlen"),
    )
    return rows.select(F.inline(F.array(own)))


def read_mash(spark: SparkSession, path: str) -> DataFrame:
    """Collapsed sites of several callers: site, genotypes, callers (SC15)."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select(f.alias("f")).where("size(f) >= 3").select(F.get("f", 0).alias("site"), F.split(F.get("f", 1), ",").alias("genotypes"), F.split(F.get("f", 2), ",").alias("callers"))


def read_repeats_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Tandem-repeat alleles: trid, chrom, s, e, motifs, id, slot, seq, purity, methylation (SC13); the pad base is taken off."""
    names = vcf_samples(spark, path)
    rows = _lines(spark, path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    info = F.split(F.get("f", 7), ";")
    text = lambda k: F.get(F.split(F.get(info, k), "="), 1)
    alleles = F.concat(F.array(F.get("f", 3)), F.split(F.get("f", 4), ","))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("id"), F.split(F.get("f", 9 + k), ":").alias("v")) for k, n in enumerate(names)])).alias("c")
    wide = rows.select(
        text(0).alias("trid"), F.get("f", 0).alias("chrom"), _long(F.get("f", 1)).alias("s"), _long(text(1)).alias("e"),
        F.split(F.element_at(F.split(F.element_at(info, -2), "="), -1), ",").alias("motifs"), alleles.alias("alleles"), each,
    )
    listed = lambda k, i: F.get(F.split(F.element_at("c.v", k), ","), i)
    slots = wide.select("*", F.posexplode(F.split(F.get("c.v", 0), "[|/]")).alias("slot", "a"))
    number = F.col("a").try_cast("int")
    return slots.where(number.isNotNull()).select("trid", "chrom", "s", "e", "motifs", F.col("c.id").alias("id"), "slot", F.substr(F.get("alleles", number), F.lit(2)).alias("seq"), listed(-2, F.col("slot")).try_cast("double").alias("purity"), listed(-1, F.col("slot")).try_cast("double").alias("methylation"))


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole JSON document (SC19)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line (SC19)."""
    return spark.read.schema(schema).json(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of sites with a header (SC22)."""
    return spark.read.csv(path, header=True, sep="\t")
