"""Word lists, markers and codes that results depend on, as plain text."""

# fixed values: pronouns and kinship words that never name an entity
PRONOUNS = (
    "그", "그녀", "그들", "그녀들", "그이", "그분", "이", "저", "얘", "걔", "쟤",
    "이쪽", "그쪽", "저쪽", "나", "너", "우리", "저희", "당신", "본인", "자신", "자기", "자기들", "여러분",
    "제", "내",
    "형", "동생", "누나", "언니", "오빠", "형님", "아우", "형수", "제수", "시동생", "처남", "매형",
    "고모", "이모", "삼촌", "외삼촌", "할아버지", "할머니", "아버지", "어머니", "아빠", "엄마",
    "아들", "딸", "남편", "아내", "부인", "배우자",
)
# fixed values: particles that may follow a pronoun; first words that refer back; characters taken off a name's ends
PRONOUN_PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "도")
REFERENTIAL_PREFIXES = ("이들", "그들", "해당")
NAME_WRAPS = "\"'“”‘’「」『』[]()（）〈〉<>《》·…⋯–—-"

# fixed values: particles and endings of search words, in the order they are tried
SEARCH_PARTICLES = ("에게", "에서", "으로", "은", "는", "이", "가", "을", "를", "과", "와", "의", "에", "로", "도", "만")
SEARCH_ENDINGS = ("하였다", "되었다", "했다", "한다", "된다", "됐다")

# fixed values: titles of articles that aren't news
EXCLUDED_TITLE_PREFIXES = ("[인사]", "[부고]", "[동정]", "[신간]")
EXCLUDED_TITLE_KEYWORDS = ("오늘의 운세", "띠별 운세")
OUTLET_TITLES_BY_DOMAIN = {"news.kbs.co.kr": ("kbs뉴스",)}
BYLINE = r"(기자|특파원|통신원)\s*="
SENTENCE_END = r"[다요]\.$"

# fixed values: site text at the head of a body
LEADING_NOISE = (
    "AD", "기사 본문 영역", "AI 해설 기사", "크게보기", "기사 읽어주기", "세 줄 요약",
    "정치", "경제", "사회", "세계", "문화", "스포츠", "국제", "IT", "연예", "공유하기",
    "구글 검색 선호 출처로 추가", "읽어주기 기능은 크롬기반의", "브라우저에서만 사용하실 수 있습니다.",
)
# fixed values: whole lines of site text at the end of a body
TRAILING_NOISE_LINES = (
    "이 기사가 좋으셨다면", "좋아요", "응원해요", "후속 원해요", "이슈",
    "■ 제보하기", "▷ 카카오톡 : 'KBS제보' 검색, 채널 추가", "▷ 유튜브, 네이버, 다음에서도 KBS뉴스를 구독해주세요!",
    "※ '당신의 제보가 뉴스가 됩니다'", "[카카오톡] YTN 검색해 채널 추가", "[전화] 02-398-8585", "[메일] social@ytn.co.kr",
    "실시간", "급상승 뉴스", "오늘의", "포토", "당신을 위한", "맞춤 뉴스by Dable",
    "관련기사", "Advertisement", "관심 있을 수도 있어요", "사진", "한 줄 정리",
    "UNMASK ]", "기사 반응 MBTI 확인", "\"기사를 읽는 동안 깨어난 당신의 숨겨진 페르소나를 AI가 스캔합니다.\"",
    "기사를 끝까지 읽으셨나요? 이제 AI 퀴즈로 기사의 핵심 내용을 점검해보세요.",
)
# fixed values: lines at which a body ends, and patterns of trailing lines
CONTENT_END_MARKERS = ("■ 제보하기", "이 기사가 좋으셨다면", "※ '당신의 제보가 뉴스가 됩니다'")
TIMESTAMP_LINE = r"^(입력|수정)\s?\d{4}-\d{2}-\d{2}"
TRAILING_NOISE = (
    r"저작권|무단\s*전재|재배포|Copyright|ⓒ|©|소셜 댓글|더보기|공유하기"
    r"|실시간 뜨거운 관심|오늘의 숏뉴스|제보는|면책 조항|투자판단의 참고용|투자 참고용"
    r"|위반 시 서비스 이용 제한|기사문의 및 제보|공감언론 뉴시스"
)
