"""Registered queries of sources and sinks: tables are written to a shared folder and read by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenotide.operators import genetics, records, registries
from phenotide.plans.fixtures import Tables
from phenotide.sources import sinks, text
from phenotide.sources.project import Project
from phenotide.sources.scratch import scratch_folder

SCRIPTS = "eid long, data_provider int, issue_date string, read_2 string, dmd_code string, bnf_code string, drug_name string, quantity string"
DEATHS = "dnx_death_id string, eid long, ins_index int, dsource string, source string, date_of_death string"


def _write_tsv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.csv(path, sep="\t", header=header, quote="")
    return path


def tsv_text(t: Tables) -> DataFrame:
    """A tab-separated table, every column as text."""
    return text.read_tsv(t.spark, _write_tsv(t.gp_clinical, scratch_folder(t.spark, "clinical")))


def tsv_typed(t: Tables) -> DataFrame:
    """The same with declared types, and the primary-care reader on top of it."""
    path = _write_tsv(t.gp_clinical, scratch_folder(t.spark, "clinical"))
    schema = "eid long, data_provider int, event_dt string, read_2 string, read_3 string, value1 string, value2 string, value3 string"
    return records.gp_records(text.read_tsv(t.spark, path, schema), ["22K.."])


def trait_list(t: Tables) -> DataFrame:
    """One code per line, and a table with a header that holds the same codes."""
    folder = scratch_folder(t.spark, "traits")
    names = t.field_dictionary.select("name", "title")
    names.select("name").write.text(f"{folder}-plain")
    _write_tsv(names.toDF("Code", "Description"), f"{folder}-table")
    lists = [text.read_trait_list(t.spark, f"{folder}-{kind}").select("Code", F.lit(kind).alias("kind")) for kind in ("plain", "table")]
    return lists[0].unionByName(lists[1])


def csv_headerless(t: Tables) -> DataFrame:
    """Prescriptions from a table without a header."""
    path = scratch_folder(t.spark, "scripts")
    t.gp_scripts.write.csv(path)
    return registries.gp_scripts(text.read_headerless_csv(t.spark, path, SCRIPTS), ["3000", "f4..."])


def csv_with_header(t: Tables) -> DataFrame:
    """Deaths written and read as comma-separated text."""
    path = scratch_folder(t.spark, "deaths")
    sinks.write_csv(t.death, path)
    return text.read_csv(t.spark, path, DEATHS)


def score_report(t: Tables) -> DataFrame:
    """A scoring report with columns separated by runs of blanks."""
    path = scratch_folder(t.spark, "report")
    lines = t.genotypes.groupBy("eid").agg((F.sum(F.coalesce("allele1_count", F.lit(0))) / 64).alias("score"))
    padded = [F.lpad(c, n, " ") for c, n in ((F.col("eid").cast("string"), 12), (F.col("eid").cast("string"), 10), (F.lit("-9"), 6), (F.col("score").cast("string"), 14))]
    lines.select(F.concat(*padded).alias("         FID        IID  PHENO        SCORE")).write.csv(path, header=True, quote="", ignoreLeadingWhiteSpace=False)
    return text.read_score_report(t.spark, path)


def score_file(t: Tables) -> DataFrame:
    """Scores of a blank-separated score file."""
    path = scratch_folder(t.spark, "scores")
    t.score_file.select("chrom", "pos", "other_allele", "effect_allele", "weight").write.csv(path, sep=" ", header=True)
    return genetics.genetic_score(t.genotypes, text.read_score_file(t.spark, path), missing="drop")


def parquet_by_chromosome(t: Tables) -> DataFrame:
    """Genotypes stored a folder per chromosome and read by the project."""
    root = scratch_folder(t.spark, "project")
    sinks.write_parquet(t.genotypes, f"{root}/data/genotypes.parquet", partition_by=["chrom"])
    stored = Project(t.spark, root).table("genotypes")
    return stored.where("chrom IN (3, 4)").groupBy("chrom", "pos").agg(F.count("*").alias("calls"), F.sum("allele1_count").alias("alleles"))


def column_dictionary(t: Tables) -> DataFrame:
    """A column dictionary written for a wide table and read back."""
    path = scratch_folder(t.spark, "dictionary")
    titles = {name: f"Title of {name}" for name in t.selfreport_participant.columns}
    sinks.write_column_dictionary(t.spark, titles, path)
    named = text.read_column_dictionary(t.spark, path)
    rows = t.selfreport_participant.agg(F.count("*")).scalar()
    return named.select("name", "title", rows.alias("rows"))


def write_if_absent(t: Tables) -> DataFrame:
    """Of two writers to one place the first one's rows stay."""
    path = scratch_folder(t.spark, "once")
    for frame in (t.coding, t.coding.where("coding > 5")):
        sinks.write_parquet(frame, path, only_if_absent=True)
    return t.spark.read.parquet(path)


def extended_versions(t: Tables) -> DataFrame:
    """A wide table extracted, extended twice under its own name, and read at its last version."""
    project = Project(t.spark, scratch_folder(t.spark, "project"))
    wide = t.selfreport_participant
    names = t.spark.createDataFrame([(name, f"Title of {name}") for name in wide.columns], "name string, title string")
    for kind, codes in (("base", ["eid", "p31"]), ("more", ["20001"]), ("last", ["p20003_i1_a0", "p31"])):
        listed = t.spark.createDataFrame([(code,) for code in codes], "value string").coalesce(1)
        listed.write.text(f"{project.columns}/{kind}.txt")
    project.extract(wide, names, "base.txt")
    for kind in ("more", "last"):
        wanted = [r[0] for r in text.read_trait_list(t.spark, f"{project.columns}/{kind}.txt").collect()]
        project.extend("base", wide, names, wanted)
    return project.table("base").select("*", F.lit(project.version("base")).alias("version"))


def manifest(t: Tables) -> DataFrame:
    """Tables named by a manifest, joined as views."""
    root = scratch_folder(t.spark, "project")
    project = Project(t.spark, root)
    sinks.write_parquet(t.baseline, f"{project.data}/file-1.parquet")
    sinks.write_parquet(t.death, f"{project.data}/file-2.parquet")
    entries = t.spark.createDataFrame([("file-1", "Baseline data"), ("file-2", "Deaths")], "Id string, Description string")
    _write_tsv(entries.coalesce(1), f"{root}/manifest.txt")
    baseline, deaths = project.register_manifest(f"{root}/manifest.txt")
    return t.spark.sql(f"SELECT eid, dob, date_of_death FROM {baseline} JOIN {deaths} USING (eid)")


QUERIES = {
    query.__name__: query
    for query in (
        tsv_text,
        tsv_typed,
        trait_list,
        csv_headerless,
        csv_with_header,
        score_report,
        score_file,
        parquet_by_chromosome,
        column_dictionary,
        write_if_absent,
        extended_versions,
        manifest,
    )
}
