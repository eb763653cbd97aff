import pytest


@pytest.fixture(autouse=True)
def few_slices(monkeypatch, request):
    """Small tables go in two slices, but for the test that names the slices."""
    from granary.llm import word_model

    if "slices" not in request.node.name:
        monkeypatch.setattr(word_model, "COUNT_SLICES", 2)
        monkeypatch.setattr(word_model, "TEXT_SLICES", 2)
