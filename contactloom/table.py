"""A pairs table: a DataFrame and the header that describes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from contactloom.header import PairsHeader


@dataclass(frozen=True)
class PairsTable:
    df: DataFrame
    header: PairsHeader

    def with_df(self, df: DataFrame, program: str | None = None, command: str | None = None) -> "PairsTable":
        """The table with other rows; its columns and, if given, the program go into the header."""
        header = self.header
        columns = [c for c in df.columns if not c.startswith("_")]
        if not header.is_empty() and columns != header.columns():
            header = header.with_columns(columns)
        if program and not header.is_empty():
            header = header.add_program(program, command)
        return PairsTable(df, header)

    def pipe(self, op: Callable[..., DataFrame], *args, program: str | None = None, **kwargs) -> "PairsTable":
        return self.with_df(op(self.df, *args, **kwargs), program)
