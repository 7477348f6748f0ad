"""Keyed one-to-one maps of strings onto strings of the same make-up."""

import hashlib
import hmac
import math
import string

# The alphabets that are kept apart. A letter becomes one of its own alphabet.
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
LATIN_MORE = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšžß"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
HEBREW = "אבגדהוזחטיכלמנסעפצקרשת"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
DEVANAGARI = "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"

DIGITS = string.digits
HEX = "0123456789abcdef"
NAME_ALPHABETS = (VOWELS, CONSONANTS, LATIN_MORE, GREEK, CYRILLIC, HEBREW, ARABIC, DEVANAGARI)
TEXT_ALPHABETS = (DIGITS, string.ascii_lowercase, LATIN_MORE, GREEK, CYRILLIC, HEBREW, ARABIC, DEVANAGARI)
_ROUNDS = 8
_HAN = (0x4E00, 0x9FA5)


def _number_below(key: bytes, *parts: object, below: int) -> int:
    message = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    size = max(16, (below.bit_length() + 7) // 8 + 8)
    out, counter = b"", 0
    while len(out) < size:
        out += hmac.new(key, b"%d:" % counter + message, hashlib.sha256).digest()
        counter += 1
    return int.from_bytes(out[:size], "big") % below


def permuted(key: bytes, name: str, value: int, size: int) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network, walked until it is in range."""
    if size <= 1:
        return value
    left_size = math.isqrt(size - 1) + 1
    right_size = -(-size // left_size)
    while True:
        left, right = divmod(value, right_size)
        for turn in range(_ROUNDS):
            if turn % 2:
                left = (left + _number_below(key, name, size, turn, right, below=left_size)) % left_size
            else:
                right = (right + _number_below(key, name, size, turn, left, below=right_size)) % right_size
        value = left * right_size + right
        if value < size:
            return value


def reworded(key: bytes, name: str, value: str, alphabets: tuple[str, ...]) -> str:
    """Another string with a character of the same alphabet at each place.

    Capitals stay capitals; characters of no alphabet stay as they are. One to one among strings
    of the same make-up, and the make-up is kept, so one to one overall.
    """
    places: list[tuple[int, str | None]] = []
    number, size, shape = 0, 1, []
    for i, char in enumerate(value):
        low = char.lower()
        alphabet = next((a for a in alphabets if low in a), None) if len(low) == 1 else None
        if alphabet is not None and (low == char or low.upper() == char):
            number, size = number * len(alphabet) + alphabet.index(low), size * len(alphabet)
            shape.append(f"{alphabets.index(alphabet)}{'u' if low != char else 'l'}")
            places.append((i, alphabet))
        elif _HAN[0] <= ord(char) <= _HAN[1]:
            width = _HAN[1] - _HAN[0] + 1
            number, size = number * width + ord(char) - _HAN[0], size * width
            shape.append("han")
            places.append((i, None))
        else:
            shape.append(char)
    number = permuted(key, f"{name}/{'/'.join(shape)}", number, size)
    out = list(value)
    for i, alphabet in reversed(places):
        if alphabet is None:
            number, at = divmod(number, _HAN[1] - _HAN[0] + 1)
            out[i] = chr(_HAN[0] + at)
        else:
            number, at = divmod(number, len(alphabet))
            new = alphabet[at]
            out[i] = new if value[i] == value[i].lower() else new.upper()
    return "".join(out)


def drawn(key: bytes, name: str, value: str, alphabet: str, length: int) -> str:
    """So many characters of the alphabet, the same for the same value."""
    number = _number_below(key, name, value, below=len(alphabet) ** length) if length else 0
    out = []
    for _ in range(length):
        number, at = divmod(number, len(alphabet))
        out.append(alphabet[at])
    return "".join(out)


# What names of each script are made of, and how those of women, men and families end.
_NAME_PARTS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"f": ("a", "ia", "ina"), "m": ("n", "r", "s", "k"), "": ("er", "sen", "man")}),
    "greek": ("βγδζθκλμνπρστ", "αειουω", {"f": ("α", "η"), "m": ("ος", "ης"), "": ("ιδης", "ακης")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": ("а", "ия"), "m": ("н", "р", "д"), "": ("ко", "ин", "ук")}),
}
_OTHER_SCRIPTS = (HEBREW, ARABIC, DEVANAGARI)


def made_name(key: bytes, name: str, value: str, gender: str, attempt: int) -> str:
    """A name of the value's script and the gender (f, m, or else a family's), with more syllables at
    each attempt."""
    first = next((c.lower() for c in value if c.isalpha()), "a")
    if _HAN[0] <= ord(first) <= _HAN[1]:
        span = _HAN[1] - _HAN[0] + 1
        number = _number_below(key, name, value, below=span ** (attempt + 1))
        return "".join(chr(_HAN[0] + number // span**i % span) for i in range(attempt + 1))
    for letters in _OTHER_SCRIPTS:
        if first in letters:
            return drawn(key, name, value, letters, attempt + 3)
    script = "greek" if first in GREEK or "\u0370" <= first <= "\u03ff" else "cyrillic" if "\u0400" <= first <= "\u04ff" else "latin"
    consonants, vowels, endings = _NAME_PARTS[script]
    endings = endings.get(gender, endings[""])
    syllables = [c + v for c in consonants for v in vowels]
    number = _number_below(key, name, value, below=len(endings) * len(syllables) ** (attempt + 1))
    number, end = divmod(number, len(endings))
    parts = []
    for _ in range(attempt + 1):
        number, at = divmod(number, len(syllables))
        parts.append(syllables[at])
    made = "".join(parts)
    made = (made[:-1] if endings[end][0] in vowels else made) + endings[end]
    return made.capitalize() if value[:1] != value[:1].lower() else made
