import pytest

pytest.importorskip("pagetrail.llm")
