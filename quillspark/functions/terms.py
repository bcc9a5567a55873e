"""Word lists and dictionaries that results depend on."""

# Aliases of the anchors, by anchor.
ALIASES = {
    "pcn": ("pcn", "pcn irrigation", "percutaneous nephrostomy", "nephrostomy catheter", "경피적 신루", "경피 신루", "신루관", "신루관 세척"),
    "foley": ("foley", "foley catheter", "폴리", "폴리 카테터", "유치도뇨관"),
    "picc": ("picc", "peripherally inserted central catheter", "말초삽입 중심정맥관", "말초삽입중심정맥관"),
    "vre": ("vre", "vancomycin resistant enterococci", "vancomycin-resistant enterococci", "반코마이신 내성 장알균", "반코마이신내성장알균"),
    "cre": ("cre", "carbapenem resistant enterobacterales", "carbapenem-resistant enterobacterales", "카바페넴 내성 장내세균", "카바페넴내성장내세균"),
    "cpe": ("cpe", "carbapenemase producing enterobacterales", "carbapenemase-producing enterobacterales", "카바페넴분해효소 생성 장내세균", "카바페넴분해효소생성장내세균"),
    "vancomycin": ("vancomycin", "vanco", "반코마이신", "반코마이신 투여"),
    "thoracentesis": ("thoracentesis", "흉강천자", "흉막천자", "늑막천자"),
}

# Words that ask for something rather than name a topic.
INTENT_TERMS = ("목적", "절차", "정의", "방법", "순서", "준비", "준비물", "주의", "주의사항", "관리", "간호", "사용", "이용", "대상", "적응증", "금기", "비교", "차이", "확인", "사항", "내용", "설명", "계산", "시행", "전후", "이후", "후에")

# Words of a question that are dropped.
STOP_TERMS = ("어떻게", "알려줘", "알려주세요", "해주세요", "해줘", "무엇인가요", "뭔가요", "관련", "지침", "그럼", "그것은", "대해서", "대해", "대한", "관한", "추가", "질문")

# Particles at the end of a word, in documents and in questions.
TEXT_PARTICLES = "에서는|으로는|이란|에는|에서|이랑|란|은|는|을|를|의"
QUESTION_PARTICLES = "에서는|으로는|이란|에는|에서|이랑|란|은|는|을|를|이|가|에|의"

# Focus words and the style of an answer, by kind of question.
FOCUSES = {
    "materials": ("준비물", "물품", "준비"),
    "preparation": ("준비", "확인", "평가", "설명", "동의", "계획"),
    "cautions": ("주의", "주의사항", "금기", "관찰", "보고", "안전", "증상", "합병증"),
    "purpose": ("목적", "정의", "예방", "위해", "이란"),
    "procedure": ("방법", "절차", "순서", "시행"),
    "release": ("해제", "종료", "중단", "기준"),
}
STYLE = {"materials": "bullets", "cautions": "bullets", "procedure": "steps", "comparison": "comparison", "summary": "summary", "synthesis": "summary", "fact": "paragraph", "purpose": "paragraph", "preparation": "bullets", "release": "bullets"}

# Terms that are added to a question that holds a term.
EXPANSIONS = {"세척": ("irrigation", "세척"), "irrigation": ("irrigation", "세척"), "격리": ("격리", "isolation"), "isolation": ("격리", "isolation"), "해제": ("해제", "종료", "중단", "기준")}

# Aspects that are written onto a topic, with the kind of question they ask.
ASPECTS = {
    "준비사항": "preparation", "체크사항": "preparation", "주의사항": "cautions", "절차": "procedure", "방법": "procedure", "순서": "procedure", "시행": "procedure",
    "목적": "purpose", "이유": "purpose", "준비": "preparation", "확인": "preparation", "주의": "cautions", "조심": "cautions", "안전": "cautions",
}

# Aspects in their plain form; labels, roles and words that aren't part of a topic.
CANONICAL_ASPECT = {"procedure": "절차", "purpose": "목적", "preparation": "준비", "cautions": "주의"}
DOCUMENT_LABELS = ("지침", "지침서", "실무지침", "실무지침서", "간호지침", "간호실무지침", "간호실무지침서")
TOPIC_ROLES = ("간호", "관리", "치료", "교육")
QUERY_NOISE = (
    "알려줘", "알려주세요", "해주세요", "해줘", "무엇인가요", "뭔가요", "뭐야", "대해서", "대해", "대한", "관한", "어떻게", "진행해", "진행하나요", "시행해", "시행하나요", "수행해", "수행하나요",
    "확인해", "준비해", "조심할", "주의할", "안전하게", "봐야", "항목", "점은", "사항은", "것은", "하는", "방법", "어떤", "전체적으로", "전반적으로", "간단히", "설명해줘", "설명해주세요", "정리해줘", "정리해주세요",
    "내용", "핵심", "핵심만",
)

# Groups of actions; an answer may not name one that its source doesn't.
ACTION_GROUPS = (r"준비|구비|챙[기겨]", r"투여|투약", r"복용", r"주입", r"주사", r"삽입|삽관", r"제거|발관", r"소독|살균", r"세척|irrigation", r"중단|종료|해제|중지", r"기록|기재|작성", r"의뢰", r"(?<![가-힣])보고|보고(?:하|해)", r"연락")

# Headings without a number, and what a unit of a quantity may be.
HEADINGS = ("목적", "준비물", "주의사항", "적응증", "금기", "시행 방법", "절차")
QUANTITY = r"[0-9]+(?:\.[0-9]+)?\s*(?:mg|ml|분|초|시간|회|개|일)"

# Where a line of a source goes on in the next one, and where it can't.
BULLET = r"^[-•●▪Ÿ*※]"
UNIT_START = r"^(?:[-•●▪Ÿ*※]|[①-⑳]|\d+(?:\.\d+)*[.)]\s|[가-하]\))|[|]|[:：]$"
GOES_ON = r"(?:[가-힣]{2,}(?:의|을|를|와|과|은|는|가|로)|[a-zA-Z%]+(?:의|을|를|로)|(?:경우|위해|하며|하여|하고|또는|및|후|전|때|없이|않고))$"
TERMINAL = r"[.!?。！？:：]$"
TITLE_END = r"(?:방법|절차|목적|기준|안내|목록)(?:\s*\[[^\]]+\])?$"
STATEMENT_END = r"[.!?。！？]$"
TITLE_UNIT = r"^\s*(?:[①-⑳]|\d+(?:\.\d+)*[.)]|[가-하]\))?\s*[^.!?。！？]{0,40}(?:방법|절차|목적|기준|투여|(?<![가-힣])(?:전|중|후))\s*$"
PROCEDURE_ACTION = "한다|하고|시행|실시|준비|기록"

# The shape of headings, labels of pages and captions.
NUMBERED_LINE = r"^(?:\d+(?:\.\d+)*[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[. ]|[가-하]\))\s*\S"
SENTENCE_END = r"(?:다[.!?]?|[。.!?])$"
HEADER_SENTENCE_END = r"(?:다[.!?]?|[.!?])$"
DOSE = r"(?i)\d\s*(?:mg|ml|㎎|㎖|℃|분|시간|회|%)"
CAPTION = r"^(?:\[[^\]]{1,50}\]|(?:예시|그림|표)\s*[①-⑳\d]+)$"

# Quantities, and marks of negation, condition, exception and case that a paraphrase must keep.
NUMBER_UNIT = r"\d+(?:[.,]\d+)?\s*(?:(?:%|mcg|μg|µg|mg|kg|gage|gauge|g|ml|l|cc|단위|분|시간|초|일|회|번|℃|°c)(?:\s*/\s*(?:hours?|hrs?|hr|minutes?|mins?|min|시간|분))?)?"
NEGATION = r"않|아니|아닌|없|금지|말(?:고|아야|라)|해서는\s*안|하지\s*말"
CONDITION = r"경우|[가-힣]+(?:으|이|하|되)?면|다면|할\s*때|[가-힣]+\s*시|\d+(?:[.,]\d+)?\s*(?:%|mg|mcg|μg|µg|g|kg|ml|mL|L|cc|단위|분|시간|초|일|회|번)?\s*(?:이상|이하|초과|미만)"
EXCEPTION = r"제외|예외|다만|단\s*,"
CASE_TARGET = r"([가-힣A-Za-z0-9_-]+)(?:인|이\s*아닌)\s*경우"
LIST_PREFIX = r"^\s*(?:[-•·]|[0-9]+[.)]|[가-하][.)])\s+"
