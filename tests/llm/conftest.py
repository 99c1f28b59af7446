import os

import pytest

if not os.path.isdir(os.path.join(os.path.dirname(__file__), "../../strandloom/llm")):
    collect_ignore_glob = ["*"]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
