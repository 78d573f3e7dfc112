"""Task functions must load in a worker that cannot import this package."""

import subprocess
import sys

from pyspark import cloudpickle

from sessionrec.llm import language_id, line_dedup, multi_order_join, simhash, tokens


def test_task_functions_load_without_the_package(tmp_path):
    calls = [
        (language_id.ngram_counts, ("some text",)),
        (simhash.fingerprint, ("some text",)),
        (line_dedup.LineDedup().parts(), ("some line of text",)),
        (multi_order_join.shingle_hasher(5), ("one two three four five six",)),
        (tokens.pack_ids, ([1, 2],)),
    ]
    path = tmp_path / "functions"
    # As PySpark does: a function of a task refers to what it needs.
    path.write_bytes(cloudpickle.dumps([lambda f=f, args=args: f(*args) for f, args in calls]))
    code = f"""
import pickle
assert all(f() is not None for f in pickle.load(open({str(path)!r}, "rb")))
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
