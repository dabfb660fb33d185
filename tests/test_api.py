import numpy as np
import pytest

from tonegrid import api


def test_files(tmp_path):
    x = np.random.default_rng(0).normal(0, 0.2, 44000).astype(np.float32)
    found = {}
    for kind in ("wav", "flac", "alac"):
        path = str(tmp_path / f"a.{kind}")
        api.write_file(path, x.reshape(-1, 2), 11025, 2, kind)
        assert api.file_sniff(path) == {"alac": "mp4"}.get(kind, kind)
        assert api.file_probe(path) == api.file_probe(path, exact=False)
        assert api.file_decode(path, 8000, True)[:2] == (8000, 1)
        found[kind] = api.file_fingerprint(path)
        assert api.file_tags(path)["title"] == ""
    assert found["wav"] == found["flac"] == found["alac"] and found["wav"][0] == 22000 / 11025
    assert api.file_wave_probe(str(tmp_path / "a.wav"))["frames"] == 22000
    words = found["wav"][1]
    assert api.words_similarity(words, words) == 1 and api.words_similarity(words[2:], words, 3) == 1 and api.words_similarity([], words) == 0


def test_errors_have_a_status(tmp_path):
    with pytest.raises(api.AudioError) as e:
        api.file_decode(str(tmp_path / "none"))
    assert e.value.status == 2
    (tmp_path / "x").write_bytes(b"hello, world")
    with pytest.raises(api.AudioError) as e:
        api.file_decode(str(tmp_path / "x"))
    assert e.value.status == 3
    for bad in ([[0.1], [0.1, 0.2]], [[0.1, 0.2, 0.3]]):
        with pytest.raises(api.AudioError) as e:
            api.write_file(str(tmp_path / "y.wav"), bad, 8000, 2)
        assert e.value.status == 1
