"""The command line runs the whole flow in its own process."""

import os
import subprocess
import sys

from docket.sources.docx import docx_bytes

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_runs_a_folder(tmp_dir):
    inbox = os.path.join(tmp_dir, "in")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "a.docx"), "wb") as fh:
        fh.write(docx_bytes("Doe v. Roe, 1 So. 3d 2 (La. 2001)\nThe court held that intentional spoliation is not a standalone tort."))
    with open(os.path.join(inbox, "b.docx"), "wb") as fh:
        fh.write(docx_bytes("No caption here."))
    out = subprocess.run([sys.executable, "-m", "docket", inbox, os.path.join(tmp_dir, "out"), "--master", "local[2]"],
                         cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "Total documents processed: 2" in out.stdout
    assert "Successful analyses: 1" in out.stdout and "Failed analyses: 1" in out.stdout
    assert "- b.docx: invalid analysis: missing blue_book_citation" in out.stdout
