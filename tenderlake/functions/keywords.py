"""Word lists and constants that results depend on. Lists serve different purposes and stay apart."""

# Stage vocabularies, matched as parts of the lower-cased stage.
DISCOVERY_SKIP = ("batal", "gagal", "pembatalan", "selesai", "tender selesai", "pascakualifikasi", "penandatanganan", "penandatanganan kontrak")
ABORTED = DISCOVERY_SKIP
AWARDED = ("kontrak", "penetapan pemenang", "pengumuman pemenang", "rekomendasi")
ACCEPT = (
    "prakualifikasi", "pengumuman prakualifikasi", "pembuktian kualifikasi", "kirim persyaratan", "kirim data", "pemasukan dokumen",
    "penyampaian dokumen", "evaluasi", "penawaran", "kualifikasi", "clarification", "jawaban", "negosiasi", "survey", "dokumen pemilihan",
    "pemilihan", "download dokumen", "unduh dokumen", "pemberian penjelasan", "penjelasan dokumen", "aanwijzing", "upload dokumen", "sanggah",
)
SUBMITTABLE = (
    "pengumuman prakualifikasi", "pengumuman pra-kualifikasi", "pengumuman kualifikasi", "pengumuman pemilihan",
    "download dokumen kualifikasi", "download dokumen pemilihan", "download dokumen prakualifikasi",
    "unduh dokumen kualifikasi", "unduh dokumen pemilihan", "unduh dokumen prakualifikasi",
    "pengambilan dokumen kualifikasi", "pengambilan dokumen pemilihan",
    "penjelasan dokumen prakualifikasi", "penjelasan dokumen kualifikasi", "penjelasan dokumen pemilihan", "pemberian penjelasan", "aanwijzing",
    "kirim persyaratan kualifikasi", "kirim data kualifikasi", "kirim dokumen kualifikasi", "kirim penawaran",
    "pemasukan dokumen kualifikasi", "pemasukan kualifikasi", "pemasukan data kualifikasi", "pemasukan dokumen penawaran",
    "penyampaian dokumen kualifikasi", "penyampaian kualifikasi", "penyampaian data kualifikasi",
    "upload dokumen kualifikasi", "upload dokumen penawaran",
)
NON_SUBMITTABLE = ("evaluasi", "pembuktian", "hasil", "sanggah", "pemenang", "kontrak", "selesai", "batal", "gagal", "lelang ulang", "tender ulang")
TERMINAL = ("selesai", "kontrak", "pembatalan", "dibatalkan", "gugur")
DASHBOARD_CLOSED = ("selesai", "kontrak", "pembatalan")
PURGE_INACTIVE = ("selesai", "kontrak", "penandatanganan", "pembatalan", "batal", "gagal")
PURGE_COMPLETED = ("selesai", "tender selesai", "pascakualifikasi", "penandatanganan", "penandatanganan kontrak")
PRAKUALIFIKASI = ("pengumuman prakualifikasi", "pembuktian kualifikasi", "kirim persyaratan kualifikasi", "prakualifikasi")
FAILED_NOTE = ("tidak lulus", "gugur", "tidak memenuhi", "ambang batas", "diskualifikasi", "batal")
DEADLINE_FIRST = ("penawaran", "submission", "pengajuan", "ajuan")
DEADLINE_SECOND = ("kualifikasi", "pra-kualifikasi", "prakualifikasi")
STAGE_GROUPS = {"prakualifikasi": ("prakualifikasi", "kualifikasi"), "pengumuman": ("pengumuman",), "evaluasi": ("evaluasi",), "penawaran": ("penawaran",)}
PROTECTED_SUBMISSIONS = ("sudah_submit", "menang", "cocok_diproses")
SUBMISSION_STATUSES = ("belum_diproses", "cocok_diproses", "sudah_submit", "menang", "gagal", "tidak_cocok")
JOB_STATUSES = ("pending", "processing", "completed", "failed", "skipped")

# Business-activity codes that are looked for, and their names.
KBLI_TARGETS = {
    "62019": "Aktivitas Pemrograman Komputer Lainnya",
    "62090": "Aktivitas Teknologi Informasi Dan Jasa Komputer Lainnya",
    "62029": "Aktivitas Konsultasi Komputer dan Manajemen Fasilitas Komputer Lainnya",
}

# Bounds of the budget ranges, both ends included.
HPS_RANGES = {
    "gt10m": (10_000_000_000, None),
    "5m_10m": (5_000_000_000, 9_999_999_999),
    "2m_5m": (2_000_000_000, 4_999_999_999),
    "1m_2m": (1_000_000_000, 1_999_999_999),
    "500j_1m": (500_000_000, 999_999_999),
    "200j_500j": (200_000_000, 499_999_999),
    "lt200j": (0, 199_999_999),
}
PROCUREMENT_KINDS = ("Pekerjaan Konstruksi", "Jasa Konsultansi", "Pengadaan Barang", "Jasa Lainnya")

# Phrases that mark a package as one of information technology.
IT_PHRASES = (
    "jaringan komputer", "jaringan internet", "jaringan lokal", "jaringan data", "jaringan wireless", "jaringan nirkabel", "lan/wan", "lan dan wan",
    "fiber optik", "fiber optic", "infrastructure network", "jaringan komunikasi", "jaringan telekomunikasi", "software", "perangkat lunak", "website",
    "web application", "sistem informasi", "sistem informasi manajemen", "sistem manajemen", "enterprise application", "data center", "datacenter",
    "data warehouse", "big data", "data analytics", "dashboard", "cyber security", "keamanan siber", "keamanan jaringan", "firewall",
    "intrusion detection", "siem", "soc", "vulnerability", "penetration test", "server", "cloud", "cloud computing", "cloud server", "virtualisasi",
    "vmware", "hypervisor", "e-government", "e-office", "e-procurement", "eprocurement", "spse", "sipd", "erdkk", "apps", "sewa bandwidth", "bandwidth",
    "leased line", "internet dedicated", "vpn", "internet", "lisensi", "license", "licensing", "managed service", "it support", "helpdesk it",
    "service desk", "devops", "devsecops", "rekayasa perangkat lunak", "rpl", "pengembangan software", "pengembangan aplikasi", "pengembangan sistem",
    "pemrograman", "artificial intelligence", "kecerdasan buatan", "machine learning", "deep learning", "iot", "internet of things", "blockchain",
    "digitalisasi", "transformasi digital", "smart city", "smartdistrict", "geospasial", "gis", "sistem geografis", "geographic information",
    "telekomunikasi", "tower telekomunikasi", "base transceiver", "microwave", "vsat", "uji sistem", "testing sistem", "quality assurance", "qa testing",
    "user acceptance", "uat", "erp", "crm", "enterprise resource", "backup", "disaster recovery", "bcp", "redundancy",
)

# Phrases that mark a package as another trade.
EXCLUSION_PHRASES = (
    "perpipaan", "pipa", "spam", "drainase", "irigasi", "jalan", "jembatan", "gedung", "bangunan", "sanitasi", "paving", "air minum", "limbah",
    "pembetonan", "aspal", "konstruksi", "infrastruktur jalan", "infrastruktur air", "tata air", "pengairan", "dam", "bendungan", "talud", "turap",
    "retaining wall", "jalan raya", "jalan tol", "jalan provinsi", "jalan kabupaten", "jalan kota", "perkerasan", "lampu jalan", "street light",
    "penerangan jalan", "trotoar", "culvert", "gorong-gorong", "box culvert", "saluran air", "water treatment", "ipal", "wwtp", "wtp", "pdam", "tirta",
    "cuci mobil", "car wash", "cuci motor", "laundry", "catering", "katering", "rumah sakit", "puskesmas", "kesehatan", "obat", "farmasi", "apotek",
    "medis", "kedokteran", "poliklinik", "ambulans", "kendaraan", "kendaraan dinas", "kendaraan operasional", "roda dua", "roda empat", "sepeda motor",
    "mobil dinas", "pengadaan mobil", "pengadaan kendaraan", "alat berat", "excavator", "buldozer", "crane", "forklift", "generator", "genset",
    "gardu listrik", "trafo", "transformator", "kabel tegangan tinggi", "tiang listrik", "solar panel", "panel surya", "plts", "pln", "material",
    "bahan bangunan", "semen", "besi", "beton", "ready mix", "ready-mix", "cor beton", "database jalan", "database jembatan", "database irigasi",
    "database sungai", "inventarisasi jalan", "inventarisasi jembatan", "pengukuran tanah", "citra satelit", "citra", "pemetaan", "ukur tanah",
    "kadastral", "astaka", "geodet", "road management", "penerbitan sk jalan",
)

# Words of the rule-based matcher.
CATEGORY_WORDS = {
    "kualifikasi_usaha": ("izin", "kualifikasi", "sbu", "usaha", "terdaftar"),
    "pengalaman": ("pengalaman", "track", "record", "portofolio", "proyek"),
    "keuangan": ("keuangan", "neraca", "labarugi", "omzet", "modal", "aset"),
    "sdm": ("sdm", "personil", "tenaga", "ahli", "certified", "sertifikasi"),
    "teknis": ("sistem", "informasi", "teknologi", "komputer", "jaringan", "software", "hardware"),
}
GATE_WORDS = ("kbli", "sbu", "npwp", "nomor pokok", "induk berusaha")

# Weights and thresholds of the opportunity score.
WEIGHTS = {"qualification": 0.35, "financial": 0.20, "experience": 0.20, "deadline": 0.15, "strategic": 0.10}
FINANCIAL_STEPS = ((0.10, 100), (0.25, 90), (0.50, 75), (0.75, 60), (1.0, 40), (1.5, 20))
DEADLINE_STEPS = ((14, 100), (7, 90), (4, 80), (2, 60), (1, 35), (0, 15))
CLASSES = ((90, "PRIORITAS_TINGGI"), (75, "LAYAK_DIKEJAR"), (60, "REVIEW"), (40, "RISIKO_TINGGI"), (0, "TIDAK_DIREKOMENDASIKAN"))

# Marks of pages without data, of texts with secrets, and words that tokens leave out.
BLOCKED_PAGE = (
    "Akses Ditolak", "tidak diizinkan", "Anda tidak diizinkan", "akses ditolak", "Just a moment", "Checking your browser",
    "Enable JavaScript and cookies to continue", "challenges.cloudflare.com", "cf-challenge-running", "Attention Required! | Cloudflare",
)
SECRET_MARKS = ("sk-", "api_key", "apikey", "authorization", "bearer ")
STOP_WORDS = (
    "dan", "di", "ke", "dari", "yang", "untuk", "dengan", "pada", "adalah", "ini", "itu", "atau", "akan", "telah", "dalam", "tidak", "bisa", "juga",
    "oleh", "karena", "mereka", "kami", "kita", "anda", "ia", "hal", "cara", "program", "upa", "upaya", "per", "tiap", "setiap", "lebih", "bagi",
    "antara", "serta", "namun", "tetapi", "jika", "maka", "sebagai", "menjadi", "harus", "wajib", "para", "tersebut", "sesuai",
)

# What is recommended for a class of score.
RECOMMENDATIONS = {
    "PRIORITAS_TINGGI": "Sangat Direkomendasikan",
    "LAYAK_DIKEJAR": "Direkomendasikan",
    "REVIEW": "Perlu Ditinjau",
    "RISIKO_TINGGI": "Perlu Ditinjau",
    "TIDAK_DIREKOMENDASIKAN": "Tidak Direkomendasikan",
}

# Weights of the categories of a company's completion.
COMPLETION_WEIGHTS = {
    "identitas": 0.20,
    "legal_kontak": 0.20,
    "keuangan": 0.20,
    "kualifikasi": 0.15,
    "pengalaman": 0.15,
    "sdm": 0.10,
}

# What is taken out of a company's name, step by step.
COMPANY_NAME_STEPS = (
    (r"(?U)^(pt\.|pt|cv\.|cv|ud\.|ud|po\.|po|fa\.|firma|koperasi|yayasan|perum|perseroan terbatas)\b[\s.]*", ""),
    (r"^(p\.t\.|c\.v\.|u\.d\.)[\s.]*", ""),
    (r"(?U)\b(tbk|persero)\b", ""),
    (r"[.,\-/()'\"]+", " "),
    (r"\s+", " "),
)

# A code behind a keyword, and keywords near which codes are looked for.
KBLI_BEHIND = r"(?i)(?:KBLI|K\.?B\.?L\.?I\.?|SBU|sub\s*bidang)[^0-9]{0,30}?(\d{2}[.\s]?\d{2}[.\s]?\d{1,2})"
KBLI_NEAR = r"(?:KBLI|SBU|sub\s*bidang)"

# The stage in a detail page's source, by the first shape that gives text.
STAGE_SHAPES = (
    r"(?i)Tahap\s+(?:Tender\s+)?Saat\s+Ini\s*[:\"]?\s*<[^>]*>\s*([^<]+)",
    r"(?i)Tahap\s+Saat\s+Ini\s*[:\"]?\s*<[^>]*>\s*([^<]+)",
    r"(?i)data-tahap[^>]*>\s*([^<]+)",
    r"(?i)class=[\"']tahap[^\"']*[\"'][^>]*>\s*([^<]+)",
)

# What a match can say of eligibility.
ELIGIBILITY = ("ELIGIBLE", "CONDITIONALLY_ELIGIBLE", "NOT_ELIGIBLE", "NOT_READY", "NOT_APPLICABLE")

# Titles of a qualification's categories and classes.
CATEGORY_TITLES = {"izin_usaha": "Izin Usaha", "sbu": "SBU (Sertifikat Badan Usaha)", "pengalaman_kerja": "Pengalaman Kerja", "sertifikasi": "Sertifikasi", "sdm": "Sumber Daya Manusia"}
CLASS_TITLES = {"kecil": "Kecil", "menengah": "Menengah", "besar": "Besar"}
# Titles of submission statuses.
SUBMISSION_TITLES = {"belum_diproses": "Belum Diproses", "cocok_diproses": "Cocok & Diproses", "sudah_submit": "Sudah Submit", "menang": "Berhasil Menang", "gagal": "Gagal Menang", "tidak_cocok": "Tidak Cocok"}
