"""Gazetteers that the labelers of `pii` look spans up in."""

#: Fixed values. Ends of host names: generic ones and those of countries.
DOMAINS = """com org net edu gov mil int info biz name pro io ai app dev co me tv cc xyz online site shop blog tech cloud email
ac ae ar at au az ba bd be bg bh bo br by ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es et eu fi fr ge gh gr gt hk hn hr hu id ie il in
iq ir is it jm jo jp ke kh kr kw kz lb lk lt lu lv ma md mk mm mn mt mu mx my na ng ni nl no np nz om pa pe ph pk pl pr ps pt py qa ro rs ru
rw sa se sg si sk sn sv sy th tn tr tw tz ua ug uk us uy uz ve vn ye za zm zw""".split()

#: Fixed values. Country codes of telephone numbers.
COUNTRIES = """1 20 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 248
249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 27 290 291 297 298 299 30 31 32 33 34 350 351 352 353 354 355 356
357 358 359 36 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 39 40 41 420 421 423 43 44 45 46 47 48 49 500 501 502 503
504 505 506 507 508 509 51 52 53 54 55 56 57 58 590 591 592 593 594 595 596 597 598 599 60 61 62 63 64 65 66 670 672 673 674 675 676 677 678
679 680 685 686 687 689 691 692 7 81 82 84 850 852 853 855 856 86 880 886 90 91 92 93 94 95 960 961 962 963 964 965 966 967 968 970 971 972
973 974 975 976 977 98 992 993 994 995 996 998""".split()

#: Fixed values. Leading digits of payment cards of 16 digits and more, as patterns.
ISSUERS = """4 5[1-5] 222[1-9] 22[3-9] 2[3-6] 27[01] 2720 6011 64[4-9] 65 62 352[89] 35[3-8] 50 5[6-9] 6[0-9] 9792 220[0-4] 81""".split()

#: Fixed values. Frequent first names of the languages that the labelers' cue words are of.
NAMES = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah
Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna
Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Hans Peter Wolfgang Klaus Jürgen Dieter Günter Stefan Andreas Uwe Ursula
Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Anna Lena Lukas Felix Jonas Maximilian Jean Pierre Michel Philippe Alain Nicolas
Christophe Laurent Marie Nathalie Isabelle Sylvie Catherine Françoise Martine Camille Léa Manon Chloé Hugo Louis Antonio José Manuel Francisco
Juan Javier Carlos Miguel Ángel Alejandro María Carmen Josefa Isabel Dolores Pilar Teresa Ana Francisca Laura Lucía Marta Paula Sofía Pablo
Diego Sergio Fernando Luis Pedro""".split()

#: Fixed values. What secrets are called where they are assigned; a hyphen, underscore or nothing may stand for each space.
SECRETS = """api key|access key|secret key|private key|client secret|secret|auth token|access token|refresh token|bearer token|token|password|passwd|
passphrase|pwd|credential|credentials|session id|signing key|encryption key|account key|connection string""".replace("\n", "").split("|")

#: Fixed values. Countries of international bank account numbers.
BANKS = """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU
LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK""".split()

#: Fixed values. Beginnings and shapes that issuers give to their keys.
KEYS = r"""(?:AKIA|ASIA)[0-9A-Z]{16} gh[pousr]_[A-Za-z0-9]{36} glpat-[A-Za-z0-9_-]{20} xox[abprs]-[A-Za-z0-9-]{10,72} AIza[0-9A-Za-z_-]{35}
sk_live_[0-9A-Za-z]{24,99} eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}""".split()
