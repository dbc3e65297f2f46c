"""Fixtures of this folder; helpers live in ``conftest_llm`` so that tests can import them."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import none, odd  # noqa: E402, F401
