"""Manifests of cases as files: ``CASE/part-i-of-n.json.gz``, each with a version, its case and documents.

A case's documents are dealt over parts by their ids, so that no part and no task holds more than
a bound however large the case is. Tasks stage their files; when all are done the
driver gives them their names and takes away parts of another number. An attempt that
fails leaves no file that a reader looks for.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.shared import small
from .store import Store

# The bound of a manifest object, the version that is written, the fields of a document.
MOST_BYTES, VERSION = 32 << 20, 2
FIELDS = "filing_id case_number docket_number title received_date official_pdf_url r2_key term_filter_b64 metadata_only".split()
MANIFEST = "version int, caseNumber string, documents array<struct<filing_id:long,case_number:string,docket_number:string,title:string,received_date:string,official_pdf_url:string,r2_key:string,term_filter_b64:string,metadata_only:boolean>>"
NAME = r"/([A-Z][A-Z0-9-]{2,30})/part-\d+-of-\d+\.json(?:\.gz)?$"


class Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str, str]]):
        self.files = files


class ManifestWriter(DataSourceWriter):
    """Rows (case_number, part, parts, document), a part's rows one after another."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.most = options["path"], int(options.get("mostbytes", MOST_BYTES))

    def write(self, iterator: Iterator) -> Staged:
        store, files, own, held, size = Store(self.uri), [], None, [], 0

        def done() -> None:
            case, part, parts = own
            data = f'{{"version":{VERSION},"caseNumber":"{case}","documents":[{",".join(held)}]}}'.encode()
            if len(data) > self.most:
                raise ValueError(f"part {part} of {case} has {len(data)} bytes, more than {self.most}")
            files.append((case, f"part-{part}-of-{parts}.json.gz", store.stage(gzip.compress(data, mtime=0))))

        for row in iterator:
            key = row.case_number, row.part, row.parts
            if own not in (None, key):
                done()
                held = []
            own = key
            held.append(row.document)
        if own:
            done()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, named = Store(self.uri), {}
        for m in messages:
            for case, name, staged in m.files if m else ():
                store.publish(staged, f"{case}/{name}")
                named.setdefault(case, set()).add(name)
        for case, kept in named.items():
            for name in store.names(case):
                if name not in kept:
                    store.delete(f"{case}/{name}")

    def abort(self, messages: list[Staged | None]) -> None:
        store = Store(self.uri)
        for m in messages:
            for *_, staged in m.files if m else ():
                store.delete(staged)


class CaseManifests(DataSource):
    """``df.write.format("case_manifests")``; options path and mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "case_manifests"

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(dict(self.options))


def write_manifests(rows: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Manifests of the cases in ``rows`` (filing_id, case_number and more of a document's fields); other cases' stay.

    A case gets as many parts as keep each at half of ``most_bytes`` on average; one that
    is over it nevertheless fails the write, and nothing changes.
    """
    rows.sparkSession.dataSource.register(CaseManifests)
    document = F.to_json(F.struct(*(c for c in FIELDS if c in rows.columns)))
    each = rows.where(F.col("case_number").isNotNull()).select("case_number", "filing_id", document.alias("document"))
    sizes = each.groupBy("case_number").agg(F.greatest(F.lit(1), F.ceil(2 * F.sum(F.octet_length("document") + 1) / most_bytes)).cast("int").alias("parts"))
    dealt = each.join(small(sizes, 100_000), "case_number").withColumn("part", F.pmod(F.xxhash64("filing_id"), F.col("parts")).cast("int"))
    placed = dealt.repartition("case_number", "part").sortWithinPartitions("case_number", "part", "filing_id")
    placed.select("case_number", "part", "parts", "document").write.format("case_manifests").options(path=path, mostBytes=most_bytes).mode("append").save()


def read_manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a (part, document) of manifest files of 32 MiB at most; the case comes from the file's path and must be that of its content."""
    rows = spark.read.schema(MANIFEST).json(path, recursiveFileLookup=True).where(F.col("_metadata.file_size") <= MOST_BYTES).withColumn("part", F.input_file_name())
    named = rows.withColumn("path_case", F.regexp_extract("part", NAME, 1)).where("version IN (1, 2) AND caseNumber = path_case")
    return named.select("part", "path_case", F.inline("documents")).withColumn("case_number", F.coalesce("case_number", "path_case")).drop("path_case")
