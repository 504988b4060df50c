"""Articles and languages."""

from __future__ import annotations

#: Articles in any language. A trailing apostrophe or hyphen joins the next word.
ARTICLES = (
    "the", "la", "a", "die", "der", "le", "el", "l'", "il", "das", "les", "i", "o", "ein",
    "un", "de", "los", "an", "una", "las", "eine", "den", "het", "gli", "lo", "os", "ang",
    "oi", "az", "een", "ha-", "det", "ta", "al-", "mga", "un'", "uno", "ett", "dem", "egy",
    "els", "eines",
)

#: Articles by language.
LANGUAGE_ARTICLES: dict[str, tuple[str, ...]] = {
    "English": ("the", "a", "an"),
    "Italian": ("la", "le", "l'", "il", "i", "un", "una", "gli", "lo", "un'", "uno"),
    "Spanish": ("la", "lo", "el", "las", "un", "los", "una", "al", "del", "unos", "unas", "uno"),
    "French": ("le", "l'", "la", "les", "un", "une", "des", "au", "du", "à la", "de la", "aux"),
    "Portuguese": ("a", "as", "o", "os", "um", "uns", "uma", "umas"),
    "Turkish": (),
}


def articles(language: str | None = None) -> tuple[str, ...]:
    """Articles of a language, those of any language where it is not known."""
    return LANGUAGE_ARTICLES.get(language or "", ARTICLES)


#: Language and the countries where it is the main one.
COUNTRIES: dict[str, tuple[str, ...]] = {
    "English": (
        "Canada", "Swaziland", "Ghana", "St. Lucia", "Liberia", "Jamaica", "Bahamas", "New Zealand", "Lesotho", "Kenya", "Solomon Islands",
        "United States", "South Africa", "St. Vincent and the Grenadines", "Fiji", "UK", "Nigeria", "Australia", "USA",
        "St. Kitts and Nevis", "Belize", "Sierra Leone", "Gambia", "Namibia", "Micronesia", "Kiribati", "Grenada", "Antigua and Barbuda",
        "Barbados", "Malta", "Zimbabwe", "Ireland", "Uganda", "Trinidad and Tobago", "South Sudan", "Guyana", "Botswana", "United Kingdom",
        "Zambia",
    ),
    "Italian": ("Italy", "San Marino", "Vatican City"),
    "Spanish": (
        "Spain", "Mexico", "Argentina", "Bolivia", "Guatemala", "Uruguay", "Peru", "Cuba", "Dominican Republic", "Panama", "Costa Rica",
        "Ecuador", "El Salvador", "Chile", "Equatorial Guinea", "Spain", "Colombia", "Nicaragua", "Venezuela", "Honduras", "Paraguay",
    ),
    "French": (
        "Cameroon", "Burkina Faso", "Dominica", "Gabon", "Monaco", "France", "Cote d'Ivoire", "Benin", "Togo", "Central African Republic",
        "Mali", "Niger", "Congo, Republic of", "Guinea", "Congo, Democratic Republic of the", "Luxembourg", "Haiti", "Chad", "Burundi",
        "Madagascar", "Comoros", "Senegal",
    ),
    "Portuguese": ("Portugal", "Brazil", "Sao Tome and Principe", "Cape Verde", "Angola", "Mozambique", "Guinea-Bissau"),
    "German": ("Liechtenstein", "Austria", "West Germany", "Switzerland", "East Germany", "Germany"),
    "Arabic": (
        "Saudi Arabia", "Kuwait", "Jordan", "Oman", "Yemen", "United Arab Emirates", "Mauritania", "Lebanon", "Bahrain", "Libya",
        "Palestinian State (proposed)", "Qatar", "Algeria", "Morocco", "Iraq", "Egypt", "Djibouti", "Sudan", "Syria", "Tunisia",
    ),
    "Turkish": ("Turkey", "Azerbaijan"),
    "Swahili": ("Tanzania",),
    "Swedish": ("Sweden",),
    "Icelandic": ("Iceland",),
    "Estonian": ("Estonia",),
    "Romanian": ("Romania",),
    "Samoan": ("Samoa",),
    "Slovenian": ("Slovenia",),
    "Tok Pisin": ("Papua New Guinea",),
    "Palauan": ("Palau",),
    "Macedonian": ("Macedonia",),
    "Hindi": ("India",),
    "Dutch": ("Netherlands", "Belgium", "Suriname"),
    "Marshallese": ("Marshall Islands",),
    "Korean": ("Korea, North", "Korea, South", "North Korea", "South Korea"),
    "Vietnamese": ("Vietnam",),
    "Danish": ("Denmark",),
    "Khmer": ("Cambodia",),
    "Lao": ("Laos",),
    "Somali": ("Somalia",),
    "Filipino": ("Philippines",),
    "Hungarian": ("Hungary",),
    "Ukrainian": ("Ukraine",),
    "Bosnian": ("Bosnia and Herzegovina",),
    "Georgian": ("Georgia",),
    "Lithuanian": ("Lithuania",),
    "Malay": ("Brunei",),
    "Tetum": ("East Timor",),
    "Norwegian": ("Norway",),
    "Armenian": ("Armenia",),
    "Russian": ("Russia",),
    "Slovak": ("Slovakia",),
    "Thai": ("Thailand",),
    "Croatian": ("Croatia",),
    "Turkmen": ("Turkmenistan",),
    "Nepali": ("Nepal",),
    "Finnish": ("Finland",),
    "Uzbek": ("Uzbekistan",),
    "Albanian": ("Albania", "Kosovo"),
    "Hebrew": ("Israel",),
    "Bulgarian": ("Bulgaria",),
    "Greek": ("Cyprus", "Greece"),
    "Burmese": ("Myanmar",),
    "Latvian": ("Latvia",),
    "Serbian": ("Serbia",),
    "Afar": ("Eritrea",),
    "Catalan": ("Andorra",),
    "Chinese": ("China", "Taiwan"),
    "Czech": ("Czech Republic", "Czechoslovakia"),
    "Bislama": ("Vanuatu",),
    "Japanese": ("Japan",),
    "Kinyarwanda": ("Rwanda",),
    "Amharic": ("Ethiopia",),
    "Persian": ("Afghanistan", "Iran"),
    "Tajik": ("Tajikistan",),
    "Mongolian": ("Mongolia",),
    "Dzongkha": ("Bhutan",),
    "Urdu": ("Pakistan",),
    "Polish": ("Poland",),
    "Sinhala": ("Sri Lanka",),
}


def language_of_countries() -> dict[str, str]:
    """Main language by country."""
    return {country: language for language, countries in COUNTRIES.items() for country in countries}
