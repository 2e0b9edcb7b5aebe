from __future__ import annotations

import pytest

from branchtally.functions import ORD
from branchtally.session import local_session
from branchtally.sources.local import local_frame


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "branchtally-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def frame(spark):
    """Builds a frame of text columns in row order: ``frame("A B", ("1", "x"), ...)``."""

    def build(columns, *rows, sep=","):
        names = columns.split(sep)
        schema = ", ".join(f"`{n}` string" for n in names) + f", `{ORD}` bigint"
        return local_frame(spark, [(*r, i) for i, r in enumerate(rows)], schema)

    return build


@pytest.fixture
def text_file(tmp_path):
    def write(content, name="raw.txt", encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content.encode(encoding))
        return str(path)

    return write


@pytest.fixture
def reference(frame):
    return frame(
        "KODE_UKER,MAIN_CODE,MAIN_BRANCH",
        ("0001", "MC10", "Jakarta Pusat"),
        ("0002", "MC20", "Surabaya"),
    )
