from pathlib import Path

import closura.llm

SOURCES = {p.name: p.read_text() for p in Path(closura.llm.__file__).parent.glob("*.py")}


def test_frames_are_broadcast_behind_a_count_only():
    """In ``checked``, which counts the rows, for the slot table, whose size is a parameter, and for anchors behind their bytes."""
    found = {name: text.count("F.broadcast(") for name, text in SOURCES.items() if "F.broadcast(" in text}
    assert found == {"decontaminate.py": 1, "sharding.py": 1, "hard_negatives.py": 1}
    assert "if anchor_bytes <= BROADCAST_BYTES" in SOURCES["hard_negatives.py"]


def test_no_local_checkpoints_cross_joins_or_python_in_native_operators():
    for name, text in SOURCES.items():
        assert "localCheckpoint" not in text and "crossJoin" not in text, name
    for name in ("chat_format.py", "decontaminate.py", "line_dedup.py", "quality.py"):
        assert not any(word in SOURCES[name] for word in ("udf(", "mapIn", "applyIn", "pandas", ".rdd", "pyarrow")), name
