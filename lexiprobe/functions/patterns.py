"""Word lists and patterns of the two sets of question rules.

They must equal those that the published labels were made with, including their slips (a star after
a letter, an emoji range that spans the CJK blocks); each list stands in its natural order. Flags
are added where they are used.
"""

from __future__ import annotations

# --- rules for the question corpus ("qa") ---
QA_EN_WH = r"\b(what*|who*|where*|when*|why*|how*|which*)\b"
QA_EN_STARTER = r"(is|are|do|does|did|have|has|can|could|will|would|should|may|might)"
FI_WH = r"\b(mik(?:ä|si)|montako|mit(?:ä|en)|miss(?:ä|tä)|mihin|mill(?:oin|ä)|kuk(?:a|aan)|ket(?:ä|kä)|ken(?:en|eltä)|kumpi|kuinka|montako)\b"
FI_POLAR = r"\b\w+(?:ko|kö)\b"
KO_WH = r"(무엇|뭐|뭣|무슨|누구|누가|어디|어느|언제|왜|어째서|어떻게|어떤|몇|얼마)"
QA_KO_ENDING = r"(습니까|읍니까|ㅂ니까|나요|가요|군요|네요|죠|인가요|인가|은가요|는가요|ㄴ가요|까요|을까요|를까요|ㄹ까요|지요|하나요|한가요|할까요|하겠나요|겠나요)\s*\??$"
QA_KO_POLAR = (
    r"(인가요|인가)\?$", r"(합니까|습니까|읍니까)\?$", r"(하나요|나요|가요|군요|네요)\?$", r"(하십니까|십니까)\?$",
    r"(한가요|은가요|는가요)\?$", r"(할까요|을까요|를까요)\?$", r"(하겠\w+가|겠\w+가)\?$", r"\?$",
)
QA_KO_OBVIOUS_WH = (r"^(무엇|누구|어디|언제|왜|어떻게) ", r"^(무슨|어느|몇) \w+ ")
QA_JA_WH = (
    r"(何|なに|なん)\b", r"(誰|だれ)\b", r"どこ\b", r"いつ\b", r"(なぜ|どうして)\b", r"(どう|どのよう|どのように)\b", r"どの\b",
    r"どんな\b", r"(いくつ|いくら)\b", r"どれ\b", r"どちら\b", r"どのくらい\b", r"いかが\b",
)
QA_JA_STRONG = (
    r"(ですか|ますか|でしょうか)[\s。]*[\?？]*$",
    r"(ある|ない|あります|ありません|います|いません|できる|できない)(か|の|ですか)[\s。]*[\?？]*$",
    r"(〜ですか|〜ますか|〜でしょうか)[\s。]*[\?？]*$",
    r"^.+は.+(?<!(なに|なん|だれ|どこ|いつ|なぜ|どう))(ですか|ますか|でしょうか)[\s。]*[\?？]*$",
    r"(ある|ない|あります|ありません|です|ます|ません)(か)[\s。]*[\?？]*$",
    r"^.+(は|が|を).+[でし]すか[\?？]?$",
    r"^.+(できます|できる|あります|ある|います|いる)(か|のか|ですか)[\?？]?$",
    r"[^か]+(か|の)[\s。]*[\?？]*$",
)
QA_JA_CLOSING = r"(ですか|ますか|でしょうか)[\s。]*[\?？]*$"
QA_JA_ASKED = r"(なに|なん|だれ|どこ|いつ|なぜ|どう).*(ですか|ますか)[\?？]?$"
QA_JA_KA = r".+か[\s。]*$"
RU_LI = r"\s+ли\b"
RU_WH = r"\b(что|чего|чему|чем|кто|кого|кому|кем|где|куда|откуда|когда|почему|зачем|как|каким\s+образом|который|как(?:ой|ая|ое|ие)|сколько)\b"
QA_AR_POLAR = r"^(هل|أ)\b"
AR_WH = r"\b(ما(?:ذا)?|من|أين|وين|متى|لماذا|ليش|كيف|أي|كم)\b"
QA_ID_POLAR = r"^(apakah|apa\s+kah|apa)\b"
QA_ID_WH = r"\b(apa\s+yang|apa\s+saja|siapa(?:kah)?|di\s+mana|dimana|ke\s+mana|kemana|dari\s+mana|darimana|kapan|bila|mengapa|kenapa|bagaimana|yang\s+mana|berapa)\b"
QA_ID_YANG = r"\bapa\s+yang\b"

# --- rules for the treebanks ("ud") ---
UD_EN_WH = r"\b(what|who|where|when|why|how|which|whose|whom)\b"
UD_EN_STARTER = r"(is|are|am|do|does|did|have|has|had|can|could|will|would|should|may|might|must|shall|isn't|aren't|don't|doesn't|didn't|won't|haven't)"
UD_EN_CONJUNCTION = r"^(but|and|so|or|yet|for) (is|are|do|does|did|have|has|can|could|will|would)"
UD_KO_ENDING = r"(까요|니까|나요|는가|을까|가요|니|까|냐|가|나)\s*\??$"
UD_JA_KA = r"(か|かな|のか|のかな|だろう|でしょう|ですか|[いな]|の|ん)[\s。]*[\?？]*$"
UD_JA_WH = r"(何|なに|なん|どこ|どちら|いつ|誰|だれ|なぜ|どうして|どう|どのよう|どの|どんな|いくつ|いくら|どれ|どんな風|いかが|どのくらい)"
UD_JA_END = r"[\?? ]$"
UD_AR_POLAR = r"^(هل|أ)\b|\bهل\b"
UD_AR_WH = AR_WH + r"|ف(ماذا|من|أين|متى|لماذا|كيف|أي)"
UD_ID_WH = (
    r"\b(apa\s+yang|siapa(?:kah)?|di\s*mana|dimana|ke\s*mana|kemana|dari\s*mana|darimana)",
    r"\b(kapan|bila(?:kah)?|bilamana|mengapa|kenapa|bagaimana(?:kah)?|yang\s+mana|berapa)",
    r"\b(bagaimana(?:kah)?\s+(?:cara|nasib|kisah|kelanjutan|reaksi|hubungan))",
    r"\b(apa\s+(?:saja|yang|arti|makna|maksud|kabar|gunanya|sebab))",
    r"\b(siapa(?:kah)?\s+(?:yang|nama|sebenarnya))",
    r"\b(mengapa\s+(?:tidak|begitu|harus|engkau|kamu))",
)
UD_ID_POLAR = (
    r"^(apakah|apa\s+kah|apa)\b",
    r"(?:^|kah\s+)(apa|ada|akankah|mau|bisa|boleh|sudah|dapat|sanggup|mungkin|perlu|harus|benar|betul|ingin|suka|mampu)",
    r"^(ada|bukan|bukankah|tidakkah|haruskah|bisakah|maukah|dapatkah|mampukah|perlukah|benarkah|betulkah|masakan)",
    r"(kan|bukan|ya|tidak|toh|dong)\s*\?",
    r"([\?\？])\s*$",
)
UD_ID_COPULA = r"^(adalah|adakah|jadikah|menjadikah|merupakan)"
UD_ID_MODAL = r"^(boleh|harus|dapat|bisa|akan|mau|perlu|ingin)\b"
UD_ID_KAH = r"\b\w+kah\b"

# --- question detection and filtering ---
QUESTION_MARKS = ("?", "؟", "︖", "﹖", "？")
JA_KA_END = r"か[\s。]*$"
KO_ENDINGS = ("까요", "니까", "나요", "는가", "을까", "가요", "니", "까", "냐", "가", "나")
BAD_MARKS = r"(\?{2,}|\?!|!\?|!{2,})"
#: Code point ranges taken for emoji.
EMOJI = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF),
    (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F), (0x1FA70, 0x1FAFF), (0x2702, 0x27B0), (0x24C2, 0x1F251),
)
