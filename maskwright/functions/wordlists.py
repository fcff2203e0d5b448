"""The fragments that synthetic names, addresses and numbers are drawn from.  Their order decides what a seed gives."""

FIRST_NAMES = {
    "id": [
        "Budi", "Siti", "Agus", "Dewi", "Eko", "Rina", "Joko", "Ayu", "Hendra", "Sri", "Bambang", "Indah", "Rizki", "Putri", "Dedi", "Nurul", "Andi",
        "Lestari", "Wahyu", "Maya", "Fajar", "Ratna", "Gunawan", "Fitri", "Slamet", "Wulan", "Iwan", "Anisa", "Yusuf", "Kartika", "Rahmat", "Melati",
        "Surya", "Intan", "Bayu", "Cahaya", "Dimas", "Larasati", "Arif", "Sinta",
    ],
    "en": [
        "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard",
        "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Charles", "Karen", "Daniel", "Nancy", "Matthew", "Lisa", "Anthony", "Margaret", "Mark",
        "Sandra", "Donald", "Ashley", "Steven", "Emily",
    ],
}
LAST_NAMES = {
    "id": [
        "Santoso", "Wijaya", "Kusuma", "Halim", "Saputra", "Nugroho", "Hidayat", "Permata", "Setiawan", "Rahayu", "Maulana", "Pratama", "Utami",
        "Firmansyah", "Anggraini", "Susanto", "Handoko", "Purnama", "Wibowo", "Puspita", "Hartono", "Sulistyo", "Mahendra", "Ramadhan", "Kurniawan",
        "Safitri", "Gunadi", "Prasetyo",
    ],
    "en": [
        "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez",
        "Wilson", "Anderson", "Taylor", "Thomas", "Moore", "Jackson", "Martin", "Lee", "Perez", "Thompson", "White",
    ],
}
STREETS = {
    "id": [
        "Jl. Sudirman", "Jl. Thamrin", "Jl. Gatot Subroto", "Jl. Diponegoro", "Jl. Ahmad Yani", "Jl. Merdeka", "Jl. Pahlawan", "Jl. Melati",
        "Jl. Kenanga", "Jl. Cempaka", "Jl. Mangga Besar", "Jl. Pemuda", "Jl. Veteran", "Jl. Kartini", "Jl. Imam Bonjol",
    ],
    "en": [
        "Main St", "Oak Ave", "Maple Dr", "Cedar Ln", "Pine Rd", "Elm St", "Washington Ave", "Lake View Dr", "Sunset Blvd", "Hillcrest Rd",
        "Park Ave", "River Rd", "Church St",
    ],
}
CITIES = {
    "id": [
        "Jakarta Selatan", "Jakarta Pusat", "Bandung", "Surabaya", "Medan", "Semarang", "Yogyakarta", "Makassar", "Palembang", "Denpasar", "Bekasi",
        "Tangerang", "Depok", "Malang",
    ],
    "en": [
        "Springfield", "Riverside", "Fairview", "Kingston", "Salem", "Georgetown", "Madison", "Clinton", "Arlington", "Ashland", "Burlington",
        "Manchester",
    ],
}
REGION_CODES = [
    "3171", "3174", "3175", "3273", "3273", "3578", "1271", "3374", "3471", "7371", "1671", "5171", "3275", "3276", "3372",
]
CARRIERS = [
    "811", "812", "813", "821", "822", "851", "852", "853", "857", "877", "895",
]
