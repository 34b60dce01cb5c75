"""The ``Tables`` bundle every operator takes (one DataFrame per domain table)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from innlytics.sources import catalog


@dataclass(frozen=True)
class Tables:
    roles: DataFrame
    users: DataFrame
    jabatan: DataFrame
    pegawai: DataFrame
    tamu: DataFrame
    tipe_kamar: DataFrame
    status_kamar: DataFrame
    kamar: DataFrame
    fasilitas: DataFrame
    kamar_fasilitas: DataFrame
    status_reservasi: DataFrame
    promo: DataFrame
    reservasi: DataFrame
    detail_reservasi: DataFrame
    metode_pembayaran: DataFrame
    pembayaran: DataFrame
    invoice: DataFrame
    checkin: DataFrame
    checkout: DataFrame
    ulasan: DataFrame
    audit_log: DataFrame

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def register_views(self, prefix: str = "") -> None:
        for name in self.names():
            getattr(self, name).createOrReplaceTempView(prefix + name)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Tables":
        """Build from a dict; missing lookup tables use the fixed rows, other
        missing tables are empty with the domain schema."""
        base = catalog.lookup_tables(spark)
        base.update(frames)
        out = {}
        for f in fields(cls):
            df = base.get(f.name)
            if df is None:
                df = catalog.empty(spark, f.name)
            out[f.name] = df
        return cls(**out)
