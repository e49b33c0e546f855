"""Record files in folders of bounded size, read back a folder to a task."""

from __future__ import annotations

import os

import pyarrow as pa

from billwright.sources import record_files


def test_a_task_reads_a_folder_not_a_list_of_files(tmp_path, monkeypatch):
    monkeypatch.setattr(record_files, "FOLDER_FILES", 3)
    monkeypatch.setattr(record_files, "BATCH_CHARS", 20)
    folder = str(tmp_path / "out")
    names = [f"é +%41 {k}.json" for k in range(7)] + [None]
    rows = pa.RecordBatch.from_pydict({"output_name": names, "value": ['{"k": "☕"}'] * 8})
    writer = record_files.RecordFilesWriter(folder, overwrite=False)
    message = writer.write(iter([rows]))
    reader = record_files.RecordFilesReader(folder)
    assert [p for p in reader.partitions() if "part-" in p.path] == []  # nothing is committed
    writer.commit([message])
    (tmp_path / "out" / "_hidden.json").write_text("{}")
    (tmp_path / "out" / "note.txt").write_text("{}")
    assert sorted(len(files) for _, _, files in os.walk(folder)) == [0, 2, 2, 3, 3]
    parts = reader.partitions()
    assert len(parts) == 5  # the root, the task's folder and three of at most three files
    read = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["output_name"] for r in read) == sorted(names[:7])
    assert {r["value"] for r in read} == {'{\n  "k": "☕"\n}'}
