"""Readers and writers: listings, captured pages, model tables, CSV and partitioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions import scalars as S


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    """(kode_instansi, cells) of listing files {"kode_instansi": .., "data": [[..], ..]}."""
    return spark.read.schema("kode_instansi string, data array<array<string>>").json(path, multiLine=True).select("kode_instansi", F.explode("data").alias("cells"))


def parse_discovery_row(rows: DataFrame, rp_compat: bool = True) -> DataFrame:
    """Listing cells as columns; rows of fewer than three cells or without an id are dropped."""
    cell = lambda i, n: S.clean_cell(F.get("cells", F.lit(i)), n)
    bidders = F.trim(S.text(F.get("cells", F.lit(9))))
    out = rows.where(F.size("cells") >= 3).select(
        "kode_instansi", cell(0, 50).alias("id_lelang"), cell(1, 500).alias("nama_paket"), cell(2, 200).alias("instansi"), cell(3, 200).alias("status"),
        S.parse_hps(F.get("cells", F.lit(4)), rp_compat).alias("hps"), cell(5, 100).alias("kualifikasi"), cell(6, 200).alias("metode"), cell(7, 200).alias("evaluasi"), cell(8, 100).alias("jenis"),
        F.when(bidders.rlike(r"^\d+$"), bidders.try_cast("int")).otherwise(0).alias("peserta_count"), cell(10, 200).alias("kontrak"),
    )
    return out.where(~F.col("id_lelang").isin("", "None"))


def page_kind(url: Column) -> Column:
    """pengumuman, jadwal, peserta, hasil or pemenang by a page's address; else ''."""
    kind = F.regexp_extract(S.text(url), r"/(pengumumanlelang|jadwal|peserta|hasil|pemenang)(?:[/?#]|$)", 1)
    return F.when(kind == "pengumumanlelang", "pengumuman").otherwise(kind)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("kind", page_kind(F.col("url")))


def _where(low: int | None, high: int | None, key: str) -> str:
    parts = [f"{key} >= {low}"] * (low is not None) + [f"{key} < {high}"] * (high is not None)
    return " AND ".join(parts) or "1 = 1"


def key_ranges(spark: SparkSession, source: str, table: str, key: str, partitions: int = 32, buckets: int = 1000, **options) -> list[str]:
    """Conditions that cut a JDBC table into ranges of an integer key of about equal numbers of rows; the first has rows without a key.

    The database counts rows by bucket of the key; a bucket with more than a range's share is counted anew in finer ones,
    so sparse ids, gaps and clusters don't skew. At most ``buckets`` numbers a query come to the driver.
    """

    key = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source).quoteIdentifier(key)

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(url=source, dbtable=f"({sql}) q", **options).load().collect()

    low, high, total = ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS c FROM {table}")[0]
    if not total:
        return ["1 = 1"]
    share = -(-total // partitions)

    def counts(low: int, high: int) -> list[tuple[int, int]]:
        """(first key, rows) of buckets in [low, high) that have rows and, unless they are of one key, a share of them at most."""
        width = max(1, -(-(high - low) // buckets))
        rows = ask(f"SELECT ({key} - {low}) / {width} AS a, COUNT(*) AS b FROM {table} WHERE {key} >= {low} AND {key} < {high} GROUP BY ({key} - {low}) / {width}")
        found = []
        for a, n in sorted((int(a), int(n)) for a, n in rows):
            begin = low + a * width
            found += counts(begin, min(begin + width, high)) if n > share and width > 1 else [(begin, n)]
        return found

    cuts, held = [], 0
    for begin, n in counts(int(low), int(high) + 1):
        if held and held + n > share:
            cuts, held = [*cuts, begin], 0
        held += n
    edges = [None, *cuts, None]
    ranges = [_where(a, b, key) for a, b in zip(edges, edges[1:], strict=False)]
    return [f"({ranges[0]}) OR {key} IS NULL", *ranges[1:]]


def read_table(spark: SparkSession, source: str, table: str | None = None, key: str = "id", partitions: int = 32, **options) -> DataFrame:
    """A model table from Parquet, or from JDBC in ranges of its key that have about equal numbers of rows."""
    if table is None:
        return spark.read.parquet(source)
    properties = {k: str(v) for k, v in options.items()}
    return spark.read.jdbc(source, table, predicates=key_ranges(spark, source, table, key, partitions, **options), properties=properties)


COLUMNS = {
    "kode_instansi": "Kode Instansi", "id_lelang": "ID Lelang", "nama_paket": "Nama Paket", "instansi": "Instansi", "satuan_kerja": "Satuan Kerja", "hps": "HPS", "jenis": "Jenis Pengadaan",
    "tahap": "Tahap Saat Ini", "kbli_code": "KBLI", "is_it_priority": "Prioritas IT", "priority_score": "Skor Prioritas", "peserta_count": "Jumlah Peserta", "lokasi": "Lokasi", "scraped_at": "Waktu Ambil",
}


def export_rows(df: DataFrame, dashboard: bool = False) -> DataFrame:
    """The exported columns under their headings; the dashboard's times have no seconds and its booleans are Ya and Tidak."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm" + ("" if dashboard else ":ss")) if kinds[c].startswith("timestamp") else F.when(F.col(c), "Ya").otherwise("Tidak") if dashboard and kinds[c] == "boolean" else F.col(c)
    return df.select(*(cell(c).alias(title) for c, title in COLUMNS.items() if c in df.columns))


def export_csv(df: DataFrame, path: str, by_instansi: bool = False, dashboard: bool = False) -> None:
    writer = export_rows(df, dashboard).write.mode("overwrite").option("header", True)
    (writer.partitionBy(COLUMNS["kode_instansi"]) if by_instansi else writer).csv(path)


def write_table(df: DataFrame, path: str, keys: list[str], tenant: str | None = None, tenants: int = 100_000, partitions: int | None = None, **options) -> None:
    """Parquet in folders by ``keys``, each task's rows of few folders; for reads of one ``tenant``, such as a company.

    Files are sorted by the tenant, so its rows lie in few row groups with narrow ranges, and have a Bloom filter of it, so
    a reader skips the groups that can't hold it. A tenant with many rows is dealt to eight tasks like any other.
    """
    dealt = df.repartition(*([partitions] if partitions else []), *keys, F.pmod(F.xxhash64(*([tenant] if tenant else df.columns[:1])), F.lit(8)))
    writer = df.write if not keys and not tenant else dealt.sortWithinPartitions(*keys, *([tenant] if tenant else [])).write
    if tenant:
        writer = writer.options(**{f"parquet.bloom.filter.enabled#{tenant}": "true", f"parquet.bloom.filter.expected.ndv#{tenant}": str(tenants)})
    writer.options(**options).mode("overwrite").partitionBy(*keys).parquet(path)
