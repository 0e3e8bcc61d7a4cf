"""Literal tables of English and Czech: numerals by value, protected words, question words, letter names."""

from __future__ import annotations

_VALUES = """
0 zero nula; 1 one; 1 jedna jeden jedno; 1 jedné jednoho jednomu jedním jednou; 2 two dva dvě; 2 dvou dvěma
3 three tři tří; 3 třech třem třemi; 4 four čtyři čtyř; 4 čtyřech čtyřem čtyřmi; 5 five pět pěti; 6 six šest šesti
7 seven sedm sedmi; 8 eight osm osmi; 9 nine devět devíti; 10 ten deset deseti; 11 eleven jedenáct jedenácti
12 twelve dvanáct dvanácti; 13 thirteen třináct třinácti; 14 fourteen čtrnáct čtrnácti; 15 fifteen patnáct patnácti
16 sixteen šestnáct šestnácti; 17 seventeen sedmnáct sedmnácti; 18 eighteen osmnáct osmnácti
19 nineteen devatenáct devatenácti; 20 twenty dvacet dvaceti; 30 thirty třicet třiceti; 40 forty čtyřicet čtyřiceti
50 fifty padesát padesáti; 60 sixty šedesát šedesáti; 70 seventy sedmdesát sedmdesáti; 80 eighty osmdesát osmdesáti
90 ninety devadesát devadesáti; 100 hundred sto; 100 stu stě; 1000 thousand tisíc tisíci
1000000 million milion milionu; 1000000 milión miliónu; 1000000000 billion miliarda miliardě
"""
#: Words with one value, in any language.
NUMERAL_VALUES: dict[str, int] = {}
for _entry in _VALUES.replace("\n", ";").split(";"):
    if _entry.strip():
        _value, *_forms = _entry.split()
        NUMERAL_VALUES.update(dict.fromkeys(_forms, int(_value)))

NUMBER_WORDS_EN = frozenset(w for w in NUMERAL_VALUES if w.isascii() and w[-2:] in ("ro", "ne", "wo", "ee", "ur", "ve", "ix", "en", "ht", "ty", "ed", "nd", "on")) - {"milion", "jeden"}
#: Czech text holds English numerals, too; plurals of large units have no value of their own.
NUMBER_WORDS_CS = frozenset(NUMERAL_VALUES) | frozenset("sta set tisíce tisících miliony milionů milióny miliónů miliard miliardy".split())

CRITICAL = frozenset(
    """aint ale_ all always ani arent bez cant cannot couldnt didnt doesnt dont every isnt jen každý must
    musí neither nelze nemůže nesmí nesmíš never nic nikdo nikdy no none nor not nothing only pouze shouldnt
    vždy všechny wasnt werent without wont wouldnt žádná žádné žádný""".split()
) - {"ale_"}

FOLDED = str.maketrans("yýíáéěúůó", "iiiaeeuuo")

_STEMS = {"kter": "ý á é í ou ého ému ém ým ých ými", "jak": "ý á é ou ého ém ým ých ými", "kolik": "a rát"}
QUESTION_WORDS = {
    "en": frozenset("how what when where which who whom whose why".split()),
    "cs": frozenset("co čeho čem čemu čí čím jak kam kde kdo kdy koho kolik kom komu kteří kudy kým nač odkud proč".split()) | {stem + end for stem, ends in _STEMS.items() for end in ends.split()},
}

LETTERS = {
    "en": dict(zip("ZYXWVUTSRQPONMLKJIHGFEDCBA", "zed why ex double_you vee you tee ess are cue pee oh en em ell kay jay eye aitch gee eff ee dee see bee ay".replace("_", "\u00a0").split(" "), strict=True)),
    "cs": dict(zip("ZYXWVUTSRQPONMLKJIHGFEDCBA", "zet ypsilon iks dvojité_vé vé ú té es er kvé pé ó en em el ká jé í há gé ef é dé cé bé á".replace("_", "\u00a0").split(" "), strict=True)),
}
LETTERS = {lang: {k: v.replace("\u00a0", " ") for k, v in names.items()} for lang, names in LETTERS.items()}
