"""Sentences with the labels that the rules must give them, worked out by hand.

(language, text, qa class, ud class, question?, rejected?, has a question word). The last tells only
for Japanese and Korean.
"""

from __future__ import annotations

P, C, N = "polar", "content", None

SENTENCES = (
    ("en", "What is the capital of Peru?", C, C, True, False, False),
    ("en", "Is Lima the capital of Peru?", P, P, True, False, False),
    ("en", "Do you know where Lima is?", P, C, True, False, False),
    ("en", "Island hopping costs much?", P, P, True, False, False),
    ("en", "Lima is nice", N, N, False, False, False),
    ("en", "The ship sank where?", C, C, True, False, False),
    ("en", "But is it far?", N, P, True, False, False),
    ("en", "Is it really??", P, P, True, True, False),
    ("en", "(Is it so?", N, P, True, True, False),
    ("en", "Is it?", P, P, True, True, False),
    ("en", "whatt now then", C, N, False, False, False),
    ("en", "Emoji here is fun \U0001f600", N, N, False, True, False),
    ("fi", "Onko Lima pääkaupunki?", P, P, True, False, False),
    ("fi", "Mikä on Perun pääkaupunki?", C, C, True, False, False),
    ("fi", "Näkö on hyvä asia", P, P, False, False, False),
    ("fi", "Lima on kaunis", N, N, False, False, False),
    ("fi", "Missä he asuvat nyt?", C, C, True, False, False),
    ("fi", "MIHIN HE MENIVÄT?", C, C, True, False, False),
    ("ru", "Знает ли он?", P, P, True, False, False),
    ("ru", "Кто он?", C, C, True, True, False),
    ("ru", "Где находится город Лима?", C, C, True, False, False),
    ("ru", "Лима красивый город", N, N, False, False, False),
    ("ru", "Как дела у вас?", C, C, True, False, False),
    ("ar", "هل هذا صحيح؟", P, P, True, False, False),
    ("ar", "متى حدث ذلك؟", C, C, True, False, False),
    ("ar", "هذا كتاب جديد", N, N, False, False, False),
    ("ar", "قل هل جاء الرجل؟", N, P, True, False, False),
    ("ar", "فماذا حدث هناك اليوم؟", N, C, True, False, False),
    ("ar", "هذا هو الجواب؟", N, C, True, False, False),
    ("id", "Apakah ini benar?", P, P, True, False, False),
    ("id", "Siapa presiden Indonesia?", C, C, True, False, False),
    ("id", "Apa yang terjadi?", C, C, True, False, False),
    ("id", "Dia pergi ke mana?", C, C, True, False, False),
    ("id", "Adakah jalan ke kota?", N, P, True, False, False),
    ("id", "Jakarta kota besar", N, N, False, False, False),
    ("id", "Dia datang bukan?", N, P, True, False, False),
    ("ko", "수도는 어디입니까?", P, C, True, True, True),
    ("ko", "어디 가나요?", C, C, True, True, True),
    ("ko", "오늘 날씨가 좋습니까?", P, P, True, True, False),
    ("ko", "밥 먹었어", N, N, False, True, False),
    ("ko", "뭐?", N, C, True, True, True),
    ("ko", "지금 가요", P, P, True, True, False),
    ("ja", "これは本ですか？", P, P, True, True, False),
    ("ja", "首都はどこですか？", P, C, True, True, False),
    ("ja", "駅はどこ？", C, C, True, True, True),
    ("ja", "行きますか。", P, P, True, True, False),
    ("ja", "雨です。", N, N, False, True, False),
    ("fr", "Où est Lima ?", N, N, True, False, False),
)
