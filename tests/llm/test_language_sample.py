"""How many rows the language model is trained and calibrated on."""

import numpy as np

from gridloom.llm import language


def test_rows_of_training_and_calibration(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "fit", lambda langs, x, y, kept, seed: seen.update(rows=len(y), calibration=int(np.sum(~kept))))
    language.trained(spark, "/root/testdata/sf0.1")
    assert seen["rows"] >= 3000 and seen["calibration"] >= 1000
