"""The command line parses its three jobs."""

import subprocess
import sys

from tests.conftest import ROOT


def test_cli_help():
    for job in ("calibrate", "update", "results"):
        out = subprocess.run([sys.executable, "-m", "expcurve", job, "--help"], cwd=ROOT,
                             capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and "--region" in out.stdout
