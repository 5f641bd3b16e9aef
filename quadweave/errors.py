"""Errors that carry a code, for the command line."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    """Codes of what went wrong."""

    QUERY_METADATA = 10
    QUERY_SAME_AS = 11
    QUERY_SUBJECTS = 12
    SUBJECT_ITERATION = 13
    QUERY_QUADS = 14
    SEED_VARIABLE_CONFLICT = 15
    REPOSITORY_CONFIG = 17
    REPOSITORY_UNSUPPORTED = 18
    REPOSITORY_VIRTUOSO = 19
    REPOSITORY_FILE = 20
    REPOSITORY_SPARQL = 22
    REPOSITORY_CLOSE = 23
    OUTPUT_UNSUPPORTED = 24
    OUTPUT_PARAM = 25
    REPOSITORY_JDBC = 27
    FILE_READ = 28
    TEMPORARY_FILE = 29
    BUFFER_QUADS = 30
    FILE_PARSE = 31
    SORT = 32
    PARSE_TEMPORARY_FILE = 33
    LOADING = 34
    HAS_NEXT = 35
    QUERY_ALL_TRIPLES = 36
    MISSING_PARAM = 37
    TUPLE_FORMAT = 38
    TUPLE_SIZE = 39
    SAME_AS_LOAD = 40
    MERGE = 41


class FusionError(Exception):
    """Something failed while reading, fusing or writing."""

    def __init__(self, code: Code, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.code = Code(code)
        self.__cause__ = cause

    def __str__(self) -> str:
        return f"Error {int(self.code)}: {self.args[0]}"


class InvalidInput(ValueError):
    """The configuration or the command line can't be used."""
