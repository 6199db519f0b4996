"""A Python worker imports first whatever module its function comes from."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", ["catalog", "catalog_more", "catalog_state", "catalog_repeats", "catalog_models", "catalog_files"])
def test_each_catalogue_can_be_imported_first(name):
    told = subprocess.run([sys.executable, "-c", f"import expodex.{name}"], cwd=HERE, capture_output=True, text=True)
    assert told.returncode == 0, told.stderr
