"""The command, from a text file to a WAV file."""

from lectern import cli
from lectern.sources import readers


def test_a_script_becomes_audio(spark, tmp_path):
    text = tmp_path / "en_talk.txt"
    text.write_text("The first lamp stands by the door.\n\nIt burns all night for us.")
    assert cli.main([str(text), str(tmp_path / "out"), "--gap", "0.5"], spark) == 0
    rate, audio = readers.decode_wav((tmp_path / "out" / "en_talk.txt.wav").read_bytes())
    assert rate == 16_000 and len(audio) / rate > 2


def test_wrong_use(spark, tmp_path):
    assert cli.main([str(tmp_path / "none.txt"), str(tmp_path)], spark) == 2
    text = tmp_path / "en_talk.txt"
    text.write_text("The first lamp stands by the door.")
    assert cli.main([str(text), str(tmp_path), "--reroll", "9"], spark) == 2
    assert cli.main([str(text), str(tmp_path), "--reroll", "0"], spark) == 2
