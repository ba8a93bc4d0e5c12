"""A project folder of stored tables, and the readers on top of it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from phenotide.functions.names import literal_col
from phenotide.operators import fields, genetics, participant, records, registries, timeline
from phenotide.operators.records import Codes
from phenotide.sources import commits, footers, sinks, text
from phenotide.sources.code_index import CodeIndex, read_code_index, write_code_index


class Project:
    """Tables of one project: Parquet under ``<root>/<data>``, column dictionaries under ``<root>/<columns>``.

    Every reader returns a lazy DataFrame. File names are arguments, with the usual names as defaults.
    A table that was extended lies in a folder per version; what counts is the last version committed.
    """

    def __init__(self, spark: SparkSession, root: str, data: str = "data", columns: str = "cols_in_tables"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.data = f"{self.root}/{data}"
        self.columns = f"{self.root}/{columns}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._versioned(self.data, name)}.parquet")

    def version(self, name: str) -> int:
        """How often a stored table was extended under its own name."""
        return self._latest(name)[0]

    def _latest(self, name: str) -> tuple[int, dict]:
        return commits.latest(self.spark, f"{self.data}/{name}.versions")

    def _versioned(self, folder: str, name: str) -> str:
        return f"{folder}/{self._latest(name)[1].get('stem', name)}"

    def index_codes(self, name: str, columns: Sequence[str]) -> None:
        """Store the distinct codes of a table's columns beside it; readers then turn patterns into equality filters.

        Once the table's files change the index is left alone until it is stored again.
        """
        write_code_index(self.table(name), columns, f"{self.data}/{name}.codes")

    def code_index(self, name: str) -> CodeIndex | None:
        return read_code_index(self.spark, f"{self.data}/{name}.codes", self.table(name))

    def null_profile(self, name: str) -> DataFrame:
        """Nulls per column of a stored table, from its footers where these tell them."""
        return footers.stored_null_profile(self.spark, f"{self._versioned(self.data, name)}.parquet")

    def coding(self, file: str) -> DataFrame:
        return text.read_tsv(self.spark, f"{self.data}/{file}").selectExpr("try_cast(coding AS int) AS coding", "meaning")

    def column_titles(self, table: str) -> dict[str, str]:
        """Column name -> title of a stored table (schema metadata, one row per column)."""
        dictionary = text.read_column_dictionary(self.spark, f"{self._versioned(self.columns, table)}.txt")
        return {row.name: row.title for row in dictionary.collect()}

    def register_manifest(self, path: str, kind: str = "data") -> list[str]:
        """Register a view for each entry of a manifest (``Id``, ``Description``); returns the view names.

        ``kind='data'``: tables, which lie under their ``Id`` in the data folder; a view is named after
        the description. ``kind='columns'``: column dictionaries (name, title), which lie under their
        ``Id`` in the dictionary folder; the view's name ends in ``_columns``, so that both manifests may
        use the same descriptions.
        """
        if kind not in ("data", "columns"):
            raise ValueError(f"kind must be 'data' or 'columns', not {kind!r}")
        views = []
        for row in text.read_tsv(self.spark, path).select("Id", "Description").collect():
            view = re.sub(r"\W+", "_", row.Description.strip().lower())
            if kind == "data":
                self.table(row.Id).createOrReplaceTempView(view)
            else:
                view += "_columns"
                text.read_column_dictionary(self.spark, f"{self.columns}/{row.Id}").createOrReplaceTempView(view)
            views.append(view)
        return views

    # Event readers. File names are fixed values.

    def read_gp(self, codes: Codes, filename: str = "GP_gp_clinical", **options) -> DataFrame:
        return records.gp_records(self.table(filename), codes, **options)

    def read_opcs(self, codes: Codes, filename: str = "HES_hesin_oper", **options) -> DataFrame:
        return records.opcs_records(self.table(filename), codes, **self._indexed(filename, options))

    def read_icd10(
        self, codes: Codes, diagfile: str = "HES_hesin_diag", recordfile: str = "HES_hesin", **options
    ) -> DataFrame:
        return records.icd10_records(self.table(diagfile), self.table(recordfile), codes, **self._indexed(diagfile, options))

    def read_icd9(
        self, codes: Codes, diagfile: str = "HES_hesin_diag", recordfile: str = "HES_hesin", **options
    ) -> DataFrame:
        return records.icd9_records(self.table(diagfile), self.table(recordfile), codes, **self._indexed(diagfile, options))

    def _indexed(self, name: str, options: dict) -> dict:
        """Options of a reader that matches patterns, with the index of its table if that is stored and current."""
        if options.get("match", "regex") != "regex" or "index" in options:
            return options
        return {**options, "index": self.code_index(name)}

    def read_gp_scripts(self, codes: Codes, filename: str = "GP_gp_scripts") -> DataFrame:
        return registries.gp_scripts(self.table(filename), codes)

    def read_death(
        self,
        codes: Codes,
        diagfile: str = "death_death_cause",
        recordfile: str = "death_death",
        baseline: str = "Baseline",
    ) -> DataFrame:
        return registries.death_records(self.table(diagfile), self.table(recordfile), self.table(baseline), codes)

    def read_cancer(
        self,
        codes: Codes,
        filename: str = "cancer_participant",
        baseline: str = "Baseline",
        histologies: str = "ICDO3.csv",
    ) -> DataFrame:
        dictionary = text.read_tsv(self.spark, f"{self.data}/{histologies}")
        return registries.cancer_registry(self.table(filename), self.table(baseline), dictionary, codes)

    # Self-report readers: wide rows, columns renamed by the table's column dictionary.

    def read_selfreport_illness(self, codes: Codes, filename: str = "selfreport_participant", **options) -> DataFrame:
        return participant.selfreport_illness(
            self.table(filename), codes, names=self.column_titles(filename), **options
        )

    def read_selfreport_cancer(self, codes: Codes, filename: str = "selfreport_participant", **options) -> DataFrame:
        return participant.selfreport_cancer(self.table(filename), codes, names=self.column_titles(filename), **options)

    def read_selfreport_treatment(
        self, codes: Codes, filename: str = "selfreport_participant", **options
    ) -> DataFrame:
        return participant.selfreport_treatment(
            self.table(filename), codes, names=self.column_titles(filename), **options
        )

    def read_selfreport_operation(
        self,
        codes: Codes,
        filename: str = "selfreport_participant",
        coding_file: str = "coding4.tsv",
        **options,
    ) -> DataFrame:
        return participant.selfreport_operation(
            self.table(filename), self.coding(coding_file), codes, names=self.column_titles(filename), **options
        )

    def first_occurrence(
        self,
        ICD10: Codes = None,
        GP: Codes = None,
        OPCS: Codes = None,
        cancer: Codes = None,
        cancer_file: str = "cancer_participant",
        match: str = "regex",
    ) -> DataFrame:
        """First date of a phenotype over the given sources; a source without codes is not queried.

        ICD-9 is no source, as its records carry no reliable dates. ``match`` applies to ICD-10,
        operation and cancer codes; primary-care codes are compared for equality.
        """
        frames = {}
        if ICD10:
            frames["ICD10"] = self.read_icd10(ICD10, match=match)
        if GP:
            frames["GP"] = self.read_gp(GP)
        if OPCS:
            frames["OPCS"] = self.read_opcs(OPCS, match=match)
        if cancer:
            found = registries.cancer_registrations(self.table(cancer_file), cancer, match=match)
            frames["cancer"] = found.withColumnRenamed("reg_date", "diag_date")
        if not frames:
            raise ValueError("first_occurrence needs codes of at least one source")
        return timeline.first_occurrence(frames)

    def genetic_score(self, score_file: str, genotypes: str = "genotypes", **options) -> DataFrame:
        return genetics.genetic_score(
            self.table(genotypes), text.read_score_file(self.spark, score_file), **options
        )

    # Column extraction.

    def extract(
        self,
        dataset: DataFrame,
        dictionary: DataFrame,
        columns_file: str,
        search_terms: Sequence[str] = (),
        use_descriptions: bool = False,
        existing: str | None = None,
        file_format: str = "parquet",
    ) -> DataFrame:
        """Store the requested columns of a wide dataset with their dictionary; returns what is stored.

        ``columns_file`` in the dictionary folder lists the codes; table and dictionary are named
        after it. The dictionary is itself a list of codes, and takes the place of a list of its name.
        ``existing`` names a stored table to extend by the columns it lacks. If that is the target
        itself, the extended table is written beside it as a new version, which counts from then on; if
        it lacks nothing, nothing is written. A table already stored under another target name stays as it
        is; that it lacks a requested column is an error.
        """
        name = columns_file.split(".")[0]
        listed = text.read_trait_list(self.spark, f"{self.columns}/{columns_file}").select(text.CODE)
        codes = [row[0] for row in listed.collect()]
        wanted = fields.resolve_fields(dictionary, dataset.columns, codes, search_terms)
        if existing == name:
            return self._extend(name, dataset, wanted, use_descriptions, file_format)
        if existing:
            chosen = fields.append_fields(
                self._read(existing, file_format), dataset, list(wanted), wanted if use_descriptions else None
            )
        else:
            chosen = dataset.select(*[literal_col(column) for column in wanted])
            chosen = fields.rename_to_titles(chosen, wanted) if use_descriptions else chosen
        stored = self._read_if_stored(name, file_format)
        if stored is None:
            self._write(chosen, f"{self.data}/{name}.{file_format}", file_format)
            sinks.write_column_dictionary(self.spark, wanted, f"{self.columns}/{name}.txt")
            return self._read(name, file_format)
        lacking = [column for column in chosen.columns if column not in stored.columns]
        if lacking:
            raise ValueError(f"{name!r} is stored without {lacking}; extend it with existing={name!r}")
        return stored

    def extend(self, name: str, dataset: DataFrame, dictionary: DataFrame, codes: Sequence[str], use_descriptions: bool = False, file_format: str = "parquet") -> DataFrame:
        """Add the columns of some codes that a stored table lacks, as its next version; returns what is stored."""
        return self._extend(name, dataset, fields.resolve_fields(dictionary, dataset.columns, codes), use_descriptions, file_format)

    def _extend(
        self, name: str, dataset: DataFrame, wanted: dict[str, str], use_descriptions: bool, file_format: str
    ) -> DataFrame:
        """Write the next version of a stored table and commit it; readers see the old one until then.

        A commit names table and dictionary together. Of two extensions of the same version one is
        committed, the other raises ``VersionConflict`` and can be run again on the new version.
        """
        number = self.version(name) + 1
        stored = self._read(name, file_format)
        extended = fields.append_fields(stored, dataset, list(wanted), wanted if use_descriptions else None)
        if extended.columns == stored.columns:
            return stored
        titles = self._known_titles(name) | wanted
        stem = f"{name}.v{number}-{uuid4().hex[:12]}"
        self._write(extended, f"{self.data}/{stem}.{file_format}", file_format)
        sinks.write_column_dictionary(self.spark, titles, f"{self.columns}/{stem}.txt")
        commits.commit(self.spark, f"{self.data}/{name}.versions", number, {"stem": stem})
        return self._read(name, file_format)

    def _known_titles(self, name: str) -> dict[str, str]:
        """The titles stored for a table; a plain list of codes in their place has none."""
        try:
            return self.column_titles(name)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
                return {}
            raise

    def _write(self, df: DataFrame, path: str, file_format: str) -> None:
        (sinks.write_csv if file_format == "csv" else sinks.write_parquet)(df, path, only_if_absent=True)

    def _read(self, name: str, file_format: str) -> DataFrame:
        if file_format == "csv":
            return text.read_csv(self.spark, f"{self._versioned(self.data, name)}.csv")
        return self.table(name)

    def _read_if_stored(self, name: str, file_format: str) -> DataFrame | None:
        try:
            return self._read(name, file_format)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
