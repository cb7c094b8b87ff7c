"""Texts of 50 MB: the memory of one task's work on one of them, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

HEAD = """
import resource, sys
import numpy as np
import pyarrow as pa
import public_tokenizers
from tessella.llm import bpe, jaccard, quality, secrets, substring, tokens
from tessella.llm._shared import Words, text_buffers
size = 50_000_000
raw = np.random.default_rng(1).integers(97, 105, size).astype(np.uint8)
raw[np.random.default_rng(2).integers(0, size, size // 6)] = 32
raw[::5000] = 10
column = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, size], np.int32)), pa.py_buffer(raw))
offsets, text = text_buffers(column)
"""
WORK = {
    "jaccard": "d, h = jaccard.shingle_sets(offsets, text, 5); size, _ = jaccard.nodes(d, h, 1); jaccard.cell_counts(d, h, size, 2); assert size[0] > 5_000_000",
    "quality": "figures = quality.measure(offsets, text); assert figures[0][0] > 5_000_000",
    "substring": "w = Words(offsets, text); keys, first = substring.window_keys(w, 50, 16); assert len(keys) > 5_000_000 and len(substring.word_digests(w)) == 1",
    "tokens": "ids, at = tokens.Encoder(public_tokenizers.path('byte_bpe_50k.json')).block(offsets, text); assert at[-1] > 5_000_000",
    "bpe": "ids, at = bpe.Speculator(public_tokenizers.path('byte_bpe_50k.json')).block(offsets, text); assert at[-1] > 5_000_000",
    "secrets": "del raw, column, text; code = ''.join(f'    value_{i % 5000} = call(first, \"text {i % 977}\") + other[3]\\n' for i in range(400_000)) + 'pwd = \"hunter2-X9f3kQ\"'; assert secrets.scan(code)[5] == 1",
}
TAIL = """
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("name", sorted(WORK))
def test_memory_of_a_long_text(name):
    root = str(Path(__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", HEAD + WORK[name] + TAIL], capture_output=True, text=True, cwd=root, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split()[-1]) < 1024, run.stdout
