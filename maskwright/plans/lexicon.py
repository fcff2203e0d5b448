"""Semantic types, the header lexicon and its scores; headers are few, so this is plain Python at plan time."""

from __future__ import annotations

import re

SEMANTIC_TYPES = ("email", "phone", "nik", "npwp", "card", "date", "name", "address", "currency", "text", "unknown")
#: plans.registry adds to it.
MODES = ["blank", "partial", "hash", "fake"]

# Header keywords by type.  The order settles ties; keywords with signs in them can only match through their synonyms,
# since headers lose their signs first.
HEADER_LEXICON: list[tuple[str, list[str]]] = [
    ("nik", ["nik", "ktp", "no_ktp", "nomor ktp", "nomor induk", "national id", "id number", "identity"]),
    ("npwp", ["npwp", "tax id", "nomor pajak"]),
    ("card", ["card", "kartu", "credit card", "kartu kredit", "pan", "card number", "no_kartu"]),
    ("email", ["email", "e-mail", "surel", "mail"]),
    ("phone", ["phone", "telepon", "telp", "hp", "no_hp", "nohp", "handphone", "mobile", "whatsapp", "wa", "kontak", "contact"]),
    ("name", ["name", "nama", "fullname", "full name", "nama lengkap", "customer", "pelanggan", "karyawan", "employee", "pegawai", "first name", "last name", "nama depan", "nama belakang"]),
    ("address", ["address", "alamat", "domisili", "street", "jalan", "kota", "city", "kelurahan", "kecamatan", "postcode", "kode pos", "zip"]),
    ("date", ["tgl_lahir", "tanggal lahir", "birth", "dob", "birthday", "date of birth", "lahir"]),
    ("currency", ["gaji", "salary", "wage", "upah", "income", "pendapatan", "saldo", "balance", "amount", "jumlah", "nominal", "harga", "price", "rekening", "account number", "no_rekening"]),
]

# The mode that fits a type best.
MODE_FOR_TYPE = {"email": "partial", "phone": "partial", "card": "partial", "nik": "hash", "npwp": "hash", "date": "partial", "name": "fake", "address": "blank", "currency": "hash", "text": "blank", "unknown": "hash"}


def normalise_header(header: str) -> str:
    """Lower case, signs as spaces, single spaces: `No. HP  (Aktif)` gives `no hp aktif`."""
    words = re.sub(r"[^a-z0-9\s]", " ", re.sub(r"[_\-.]+", " ", header.lower()))
    return " ".join(words.split())


def score_header(header: str) -> tuple[str, float]:
    """(type, score): 1 for the keyword itself, 0.85 for whole words of the header, 0.6 for a part of it from four letters on; the first best keyword wins."""
    name = normalise_header(header)
    best = ("unknown", 0.0)
    for kind, keywords in HEADER_LEXICON if name else ():
        for word in keywords:
            whole = re.search(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])", name)
            score = 1.0 if name == word else 0.85 if whole else 0.6 if len(word) >= 4 and word in name else 0.0
            if score > best[1]:
                best = (kind, score)
    return best


def column_label(index: int) -> str:
    """Spreadsheet column names: 0 is A, 25 Z, 26 AA."""
    label = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        label = chr(65 + rest) + label
    return label
