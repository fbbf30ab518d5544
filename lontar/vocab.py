"""Word lists, patterns and constants of the rules.

Fixed values: results depend on each of them, and on the order of those that are applied one after the other.
Patterns hold for Java's and RE2's syntax alike. S, W and D are the white-space, word and digit classes of Unicode.
"""

from __future__ import annotations

S = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
W = r"\p{L}\p{N}_"
D = r"\p{Nd}"

# ---- fixed values: document cleaning ---------------------------------------------------------------------------------
MOJIBAKE = [
    ("â€\"", "—"),
    ("â€˜", "'"),
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("â€¦", "..."),
    ("&nbsp;", " "),
    ("Â ", " "),
    ("Ã¢", "â"),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã", "à"),
    ("\x00", ""),
    ("﻿", ""),
]
DROPCAP_WORDS = [
    ("sjid", "Masjid"), ("syarakat", "Masyarakat"), ("ikmah", "Hikmah"), ("kmurkan", "Makmurkan"), ("omili", "Homili"), ("njil", "Injil"), ("ukaristi", "Eukaristi"),
    ("ati", "Hati"), ("adir", "Hadir"), ("ari", "Hari"), ("arapan", "Harapan"), ("esar", "Besar"), ("erita", "Berita"),
]
TITLES = ["Bp", "Mgr", "Pdt", "Rm", "Sr", "Fr", "St", "Drs", "Dr", "Prof", "KH", "H", "Hj", "Ust", "Ustad", "Ustadz", "Rev", "Pastor"]
NAV_KEYWORDS = [
    "facebook", "instagram", "twitter", "youtube", "whatsapp", "telegram", "tiktok", "home", "menu", "beranda", "tentang", "download", "kategori", "arsip", "komentar", "baca juga",
    "read more", "selengkapnya", "lihat semua", "view all", "tags", "share", "bagikan", "print", "cetak", "next", "previous", "older", "newer", "subscribe", "newsletter", "search",
    "cari", "login", "logout", "register", "daftar", "sign in", "sign up", "follow us", "ikuti kami", "artikel terkini", "video terkini", "berita terkini", "post terkini",
    "artikel terbaru", "video terbaru", "berita terbaru",
]
BIBLE_BOOKS = [
    "Yohanes", "Matius", "Markus", "Lukas", "Kisah", "Roma", "Korintus", "Galatia", "Efesus", "Filipi", "Kolose", "Tesalonika", "Timotius", "Titus",
    "Filemon", "Ibrani", "Yakobus", "Petrus", "Yudas", "Wahyu", "Kejadian", "Keluaran", "Imamat", "Bilangan", "Ulangan", "Yosua", "Hakim", "Rut",
    "Samuel", "Raja", "Tawarikh", "Ezra", "Nehemia", "Ester", "Ayub", "Mazmur", "Amsal", "Pengkhotbah", "Kidung", "Yesaya", "Yeremia", "Ratapan",
    "Yehezkiel", "Daniel", "Hosea", "Yoel", "Amos", "Obaja", "Yunus", "Mikha", "Nahum", "Habakuk", "Zefanya", "Hagai", "Zakharia", "Maleakhi", "John",
    "Matthew", "Mark", "Luke", "Acts", "Romans", "Corinthians", "Galatians", "Ephesians", "Philippians", "Colossians", "Thessalonians", "Timothy",
    "Titus", "Philemon", "Hebrews", "James", "Peter", "Jude", "Revelation", "Genesis", "Exodus", "Leviticus", "Numbers", "Deuteronomy", "Joshua",
    "Judges", "Ruth", "Samuel", "Kings", "Chronicles", "Ezra", "Nehemiah", "Esther", "Job", "Psalms?", "Proverbs", "Ecclesiastes", "Song", "Isaiah",
    "Jeremiah", "Lamentations", "Ezekiel", "Daniel", "Hosea", "Joel", "Amos", "Obadiah", "Jonah", "Micah", "Nahum", "Habakkuk", "Zephaniah", "Haggai",
    "Zechariah", "Malachi",
]
BIBLE_REF = rf"(?i)\b(?:1|2|3|I{{1,3}})?[{S}]*(?:{'|'.join(BIBLE_BOOKS)})[{S}]*{D}{{1,3}}(?::{D}{{1,3}}(?:[{S}]*-[{S}]*{D}{{1,3}})?)?\b"
QURAN_REF = rf"(?i)\b(?:Q\.?S\.?|Surah?|Al-?)[{S}]*[A-Za-z\-]+[{S}]*(?:\(?{D}{{1,3}}\)?)?(?::{D}{{1,3}}(?:-{D}{{1,3}})?)?\b"
QURAN_REF_NUMBERED = rf"(?i)\b(?:Q\.?S\.?|Surah?|Al-?)[{S}]*[A-Za-z\-]+[{S}]*\(?{D}{{1,3}}\)?(?::{D}{{1,3}}(?:-{D}{{1,3}})?)?\b"
METADATA_TAILS = [
    rf"(?i)\|[{S}]*Halaman ini adalah[^\n]*",
    rf"(?i)\x{{a9}}[{S}]*{D}{{4}}[^\n]*",
    rf"(?i)Copyright[{S}]*\x{{a9}}?[^\n]*",
    r"(?i)All rights reserved[^\n]*",
    r"(?i)Hak cipta[^\n]*",
]
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]+"

# ---- fixed values: sentence cleaning, in order -----------------------------------------------------------------------
DASH = r"\-\x{2013}\x{2014}"
SENTENCE_STEPS = {
    "cs_url": [(rf"(?i)https?://[^{S}]+|www\.[^{S}]+|[{W}]+\.com[^{S}]*|[{W}]+\.org[^{S}]*|[{W}]+\.id[^{S}]*|[{W}]+\.net[^{S}]*", "")],
    "cs_lead_citation": [(rf"^[{S}]*\([A-Za-z0-9{S}\.\-:/]+\)[{S}]*", "")],
    "cs_lead_partial_citation": [(rf"(?i)^[{S}]*\(/?[A-Za-z]*/?[{S}]*{D}+[:{S}]+{D}+[^)]*\)[{S}]*", "")],
    "cs_verse": [(rf"(?i)\(ayat[{S}]*{D}+[^)]*\)", "")],
    "cs_abbrev_ref": [(rf"\([A-Za-z]{{2,4}}\.[{S}]*{D}+[^)]*\)", "")],
    "cs_num_paren": [(rf"\([^)]*{D}+[:{S}]+{D}+[^)]*\)", "")],
    "cs_title_paren": None,
    "cs_com_prefix": [(rf"^Com[{S}]*[{DASH}]?[{S}]*", "")],
    "cs_dateline": [(rf"^[A-Z][a-z]+(?:[{S}]*,[{S}]*[A-Z][a-z]+)*(?:[{S}]*,[{S}]*{D}{{1,2}}[{S}]+[A-Z][a-z]+[{S}]+{D}{{4}})?[{S}]*[{DASH}][{S}]*", "")],
    "cs_dashes": [(rf"[{DASH}][{S}]*[{DASH}]", " "), (rf"[{S}]+[{DASH}][{S}]+", " ")],
    "cs_author_date": [(rf"^[A-Z][a-z]+[{S}]+[A-Z][a-z]+[^\n]*?[|][{S}]*{D}{{1,2}}[-/]{D}{{1,2}}[-/]{D}{{2,4}}", "")],
    "cs_ellipsis_marker": [(r"\[\x{2026}\]", ""), (r"\[\.\.\.\]", "")],
    "cs_attribution": [(rf"(?i)Created by[{S}]+[{W}]+[^\n]*$|Designed by[{S}]+[{W}]+[^\n]*$|Powered by[{S}]+[{W}]+[^\n]*$", "")],
    "cs_bank": [(rf"\b[A-Z]{{2,5}}:[{S}]*{D}{{8,}}[a-z\.]*", "")],
    "cs_separator": [(r"[=\-\*]{3,}", " ")],
    "cs_donation": [(r"(?i)Para dermawan bisa donasi[^\n]*$", ""), (r"(?i)dengan mengklik banner[^\n]*$", "")],
    "cs_readers": [(rf"(?i)^Jumlah[{S}]+Pembaca[{S}]*:[{S}]*{D}+[{S}]+", "")],
    "cs_read_online": [
        (rf"(?i)Baca[{S}]+online[{S}]*:[^\n]*$", ""),
        (rf"(?i)Pelajaran[{S}]+{D}+[{S}]*\|[{S}]*Pertanyaan[{S}]+{D}+[{S}]*\|[{S}]*Referensi[{S}]+{D}+[^\n]*$", ""),
    ],
    "cs_name_list": [(rf"[A-Z][a-z]+[{S}]+[A-Z][a-z]+-[{S}]*Wil[{S}]+{D}+[{S}]*:[{S}]*Pdt[{S}]+[A-Z][a-z]+[^\n]*$", "")],
    "cs_copyright": [(r"\x{a9}[^\n]*$", "")],
    "cs_space_punct": [(r"([.!?])([A-Z])", "$1 $2")],
    "cs_space_paren": [(r"\)([A-Z])", ") $1")],
    "cs_space_colon": [(r":([A-Za-z])", ": $1")],
    "cs_punct_dup": [(rf",[{S}]*,", ","), (rf"\.[{S}]*\.", "."), (r"\.{3,}", "...")],
    "cs_list_marker": [(rf":{D}+\.?[{S}]*$", ""), (rf"#{D}+[:\.]", "")],
    "cs_edge_quotes": [],
    "cs_edge_ellipsis": [(rf"^\.{{2,}}[{S}]*", ""), (rf"[{S}]*\.{{2,}}$", "")],
    "cs_inner_quotes": [("[\"']", "")],
    "cs_collapse": [(rf"[{S}]+", " "), ("^ | $", "")],
}
#: Quotation marks and brackets that go from both ends of a sentence.
EDGE_QUOTES = r"\x{22}\x{27}\x{60}\x{201c}\x{201d}\x{2018}\x{2019}\x{201e}\x{201f}\x{ab}\x{bb}\x{3008}\x{3009}\x{300a}\x{300b}\x{300c}\x{300d}\x{300e}\x{300f}\x{2039}\x{203a}"
SENTENCE_STEPS["cs_edge_quotes"] = [(rf"^[{S}{EDGE_QUOTES}]+", ""), (rf"[{S}{EDGE_QUOTES}]+$", "")]
TITLE_PAREN = r"\([^)]{20,}\)"

# ---- fixed values: the validity cascade ------------------------------------------------------------------------------
MIN_CHARS, MAX_CHARS, MIN_WORDS, MAX_WORDS = 25, 500, 5, 100
WHITELIST = [
    "amin", "alleluia", "hallelujah", "puji tuhan", "selamat paskah", "selamat natal", "selamat idul fitri", "selamat lebaran", "alhamdulillah", "subhanallah", "masya allah",
    "insya allah", "assalamualaikum", "bismillah", "astaghfirullah", "syukur",
]
CONNECTORS = [
    "namun", "lalu", "bahkan", "kemudian", "selanjutnya", "pertama", "kedua", "ketiga", "keempat", "dengan demikian", "oleh karena itu", "oleh sebab itu", "karena itu", "sebab itu",
    "maka", "jadi", "sehingga", "padahal", "sedangkan", "sebaliknya", "begitu pula", "demikian pula", "apa itu", "berikut ini", "di antaranya",
]
SHORT_CONNECTORS = ["tapi", "sebab", "kalo", "kalau", "jika", "bila", "saat", "ketika", "aku", "kita", "kami", "gimana", "bagaimana", "apakah", "maka"]
QUESTION_WORDS = ["bagaimana", "gimana", "apakah", "kenapa", "mengapa", "siapa", "dimana", "kapan", "berapa", "apa"]
BOILERPLATE = [
    "skip to content", "lihat lebih banyak", "baca selengkapnya", "read more", "lihat semua", "view all", "see more", "load more", "show more", "baca juga", "artikel terkait",
    "berita terkait", "related posts", "older posts", "newer posts", "next page", "previous page", "halaman selanjutnya", "halaman sebelumnya", "category archives", "share this",
    "bagikan ini", "ikuti kami", "follow us", "subscribe", "berlangganan", "join our", "gabung dengan", "log into your account", "your username", "your password",
    "forgot your password", "reset your password", "sign in", "sign up", "create account", "register here", "daftar sekarang", "enter your email", "type your email",
    "no comments yet", "be the first", "leave a comment", "add a comment", "comments (0)", "komentar (0)", "cookie policy", "privacy policy", "terms of service",
    "penggunaan cookie", "setuju atau batalkan", "cookies dalam situs", "kami menggunakan cookie", "mengakses kami menggunakan cookie", "kenyamanan anda selama mengakses",
    "cookies untuk memastikan", "you need javascript", "javascript enabled", "enable javascript", "unable to retrieve", "error loading", "no videos found", "api key",
    "invalid channel", "slot gacor", "slot online", "jackpot", "rtp slot", "indobet", "situs slot", "main slot", "judi online", "poker online", "togel online", "live casino",
    "deposit pulsa", "bonus deposit", "rtp real-time", "peluang menang", "provider game", "situs terpercaya", "game dengan rtp", "makin tinggi rtp", "update info rtp",
    "biaya pendaftaran ditransfer", "klik/tap pada gambar untuk memesan", "transfer ke rekening", "nomor rekening", "biaya registrasi", "click here", "klik di sini", "tap here",
    "press here", "ingin berlangganan", "silahkan klik", "akses kalkulator", "required fields", "fields are marked", "save my name", "time i comment", "cancel reply",
    "post comment", "created by", "designed by", "powered by", "developed by", "dapatkan update", "mohon doa", "di sini!", "misa harian:", "jadwal misa", "jadwal ibadah",
]
ADDRESS = (
    rf"(?i)(?:Jl\.|Jln\.|Jalan|Kotak Pos|Kode Pos|Kantor)[{S}]+[A-Za-z0-9{S}\.\,]+(?:{D}{{5}}|Bandung|Jakarta|Surabaya|Semarang|Yogyakarta|Medan|Makassar|Palembang|Denpasar|Jawa|"
    r"Sumatera|Kalimantan|Sulawesi)"
)
PHONE = rf"(?i)(?:Telp|Telepon|Fax|Faks|Hotline|Hubungi|No\.?[{S}]*HP|WhatsApp|WA|Kotak Pos)[{S}]*[:\.]?[{S}]*[{D}\-\({S}\)\+]{{5,}}"
PHONE_NUMBER = rf"\({D}{{3,4}}\)[{S}]*{D}{{4,}}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
POSTAL_CODE = rf"\b{D}{{5}}\b"
DATE_CONCAT = (
    rf"(?i){D}{{1,2}}[{S}]*(?:Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember|January|February|March|May|June|July|August|October|December)"
    rf"[{S}]*,?[{S}]*{D}{{4}}[A-Z]"
)
NAV_CAPS = ["MENU", "HOME", "KREDO", "LITURGY", "WHAT WE", "SEE OTHERS", "Q&A"]
DANGLING = [
    "dan", "atau", "yang", "di", "ke", "dari", "untuk", "dengan", "pada", "ini", "itu", "adalah", "via", "melalui", "lewat", "silakan", "klik", "akses", "seperti", "yaitu", "yakni",
    "berkata", "menyatakan", "mengatakan",
]
CUT_ABBREVIATIONS = ["terj", "dll", "dkk", "dst", "etc"]
BOILERPLATE_START = (
    rf"^(?:artikel[{S}]*/?[{S}]*video[{S}]+terkini|baca[{S}]+juga|lihat[{S}]+juga|berita[{S}]+terkait|artikel[{S}]+terkait|tags?[{S}]*:|kategori[{S}]*:|share[{S}]*:|bagikan[{S}]*:|"
    rf"sumber[{S}]*:|foto[{S}]*:|credit[{S}]*:|gambar[{S}]*:|{D}+[{S}]*(?:shares?|likes?|views?|komentar)|streaming[{S}]+(?:tidak[{S}]+)?terdengar|mau[{S}]+bertanya|"
    rf"ingin[{S}]+tahu[{S}]+jawabannya|kalo[{S}]+aku[{S}]+sih|jika[{S}]+streaming)"
)
METADATA_SIGNATURE = rf"(?i)\((?:Kontributor|Editor|Penulis|Fotografer|Sumber):[{S}]*[^)]+\)"
NAME_ENDINGS = ["pada", "di", "dengan", "untuk", "dari", "ke", "itu", "ini"]
NAV_DENSITY = [
    "home", "search", "login", "view", "tags", "menu", "page", "next", "previous", "click", "back", "top", "share", "print", "more", "read", "see",
    "all", "show", "hide", "close", "open", "skip", "subscribe", "newsletter", "follow", "join", "register", "sign",
]

# ---- fixed values: pages and links -----------------------------------------------------------------------------------
#: Names under which pages are asked for, and how many requests may be under way, in all and of a domain. Fixed values.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
]
GLOBAL_LIMIT = 400
DOMAIN_LIMIT = 13
HIDDEN_ELEMENTS = ["script", "style", "nav", "header", "footer", "aside", "form", "button", "input", "select", "noscript", "iframe"]
DROPCAP_TAGS = ["span", "div", "p", "b", "strong", "i", "em"]
DROPCAP_CLASSES = ["drop", "initial", "first", "cap", "big", "letter", "lead"]
DROPCAP_STYLES = ["float", "font-size:", "line-height:", "display:block"]
DROPCAP_HTML = [
    (rf'(?i)<(?:span|div)[^>]*class="[^"]*(?:drop|initial|first|big|cap|letter)[^"]*"[^>]*>([A-Za-z]{{1,3}})</(?:span|div)>[{S}]*([a-z]+)', "$1$2"),
    (rf'(?i)<(?:span|div)[^>]*style="[^"]*(?:float|font-size:[{S}]*[2-9])[^"]*"[^>]*>([A-Za-z]{{1,3}})</(?:span|div)>[{S}]*([a-z]+)', "$1$2"),
    (rf"(?i)<(?:span|div|b|strong)[^>]*>([A-Z]{{1,2}})</(?:span|div|b|strong)>[{S}]*([a-z]{{2,}})", "$1$2"),
]
SKIPPED_EXTENSIONS = [
    "pdf", "jpg", "jpeg", "png", "gif", "zip", "doc", "docx", "xls", "xlsx", "mp3", "mp4", "avi", "mov", "css", "js", "ico", "svg", "woff", "woff2",
    "ttf", "eot",
]
SKIPPED_FRAGMENTS = ["/feed", "/rss", "/sitemap", "/api/", "/ajax/", "/wp-json/", "/wp-admin/", "/wp-includes/", "/cgi-bin/", "/.well-known/"]
SKIPPED_SCHEMES = ["mailto:", "tel:", "javascript:", "#", "data:"]
TRACKING = rf"[?&](?:utm_[{W}]+|ref|source|fbclid|gclid|_ga)=[^&]*"
MAX_SEGMENTS, MAX_DEPTH, DOMAIN_CAP, MIN_HTML = 6, 8, 100_000, 100

# ---- fixed values: rate limits, labels, languages --------------------------------------------------------------------
START_DELAY, MIN_DELAY, MAX_DELAY, SPEED_UP, SLOW_DOWN = 0.01875, 0.00375, 2.0, 0.95, 1.5
COOLDOWN_SECONDS, COOLDOWN_DELAY, SUCCESSES, MAX_RETRIES = 60.0, 5.0, 10, 2
LABELS = {"Islam": 0, "Catholic": 1, "Protestant": 2}
TARGET_LANGUAGES = ("id", "ms", "tl")
OUTPUT_COLUMNS = ["Label", "Denomination", "Location", "Date", "Title", "Sentence_Unit", "Link"]
