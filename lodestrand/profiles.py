"""Lexical rules of a language as one parameter object."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases, words, brackets and limits that results depend on, in their natural order.
JA_NOISE = (
    "カートに入れる", "カートを見る", "買い物かご", "ショッピングカート", "お気に入りに追加", "レビューを書く", "レビューはまだありません",
    "ログイン", "ログアウト", "会員登録", "新規登録", "マイページ", "会社概要", "運営会社", "特定商取引法", "プライバシーポリシー", "利用規約",
    "個人情報保護", "お問い合わせ", "サイトマップ", "よくある質問", "配送について", "送料無料キャンペーン", "クーポン", "ポイント還元", "在庫状況",
    "検索結果", "絞り込み", "並び替え", "前のページ", "次のページ", "トップページ", "javascript", "cookie", "クッキー", "ブラウザの設定",
    "all rights reserved", "copyright",
)
JA_BRACKETS = (
    ("【", "】"), ("［", "］"), ("[", "]"), ("〔", "〕"), ("≪", "≫"), ("《", "》"), ("〈", "〉"), ("＜", "＞"), ("（", "）"), ("(", ")"),
    ("＼", "／"), ("★", "★"), ("☆", "☆"), ("■", "■"), ("◆", "◆"), ("●", "●"),
)
JA_PROMO = (
    "送料無料", "送料込", "全国送料", "あす楽", "即日発送", "当日発送", "翌日配送", "ポイント", "pt", "クーポン", "セール", "sale", "off", "オフ", "割引", "値引",
    "特価", "激安", "半額", "最安", "お買い得", "買い回り", "エントリー", "楽天", "amazon", "yahoo", "ランキング", "1位", "第1位", "受賞", "殿堂",
    "在庫", "税込", "税抜", "円", "%", "％", "倍", "まとめ買い", "定期便", "会員限定", "先着", "抽選", "無料", "キャンペーン", "数量限定", "期間限定", "限定価格",
)
JA_APPEAL = (
    "おいしい", "美味しい", "うまい", "旨味", "風味", "香り", "食感", "人気", "話題", "評判", "定番", "名物", "自慢", "看板",
    "厳選", "こだわり", "こだわっ", "選び抜", "吟味", "贅沢", "上質", "最高", "極上", "特別", "希少", "限定", "職人", "老舗", "伝統", "手作り", "手づくり", "自家製",
    "産", "国産", "天然", "無添加", "有機", "オーガニック", "品質", "安心", "安全", "新鮮", "獲れたて", "採れたて",
    "おすすめ", "ぴったり", "喜ば", "贈り物", "ギフト", "プレゼント", "特徴", "使用", "採用", "仕上げ", "製法", "配合", "設計", "機能",
)
JA_WEAK = (
    "円", "税込", "税抜", "発送", "配送", "納期", "在庫", "注文", "返品", "交換", "キャンセル", "支払", "決済", "銀行", "クレジット",
    "営業日", "定休日", "電話", "メール", "住所",
)
DECORATION = "★☆■□◆◇●○▲△▼▽※＼／\\/｜|＊*＋+〜~ 　"
NOISE_TAGS = (
    "script", "style", "noscript", "template", "iframe", "svg", "canvas", "form", "input", "button", "select", "textarea",
    "nav", "header", "footer", "aside", "menu", "dialog",
)
NOISE_ROLES = ("navigation", "banner", "contentinfo", "search")
NOISE_HINTS = (
    "ad-", "-ad", "ads", "advert", "banner", "breadcrumb", "footer", "header", "global-nav", "gnav", "sidebar", "side-bar", "sidemenu", "widget", "popup", "modal",
    "cookie", "social", "share", "sns", "pagination", "pager", "recommend", "ranking", "related", "review-list", "comment", "copyright", "navigation",
)
BLOCK_TAGS = ("p", "div", "li", "tr", "td", "th", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "blockquote")
PRODUCT_TYPES = ("product", "individualproduct", "productmodel", "productgroup", "vehicle", "book")
CHARSET_ALIASES = {
    "shift-jis": "cp932", "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms932": "cp932",
    "euc-jp": "euc_jp", "eucjp": "euc_jp", "x-euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "utf8": "utf-8", "utf-8": "utf-8", "ascii": "utf-8", "us-ascii": "utf-8",
}
UNKNOWN_TITLE = "(不明)"
JA_TERMINATORS = "。．！？!?"
JA_CLOSERS = "」』）\\)】〉》〕］\\]"
JA_SOFT_BREAKS = "、，,；;："
JA_SCRIPT = "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}々ー"
JA_PRICE = "[0-9０-９][0-9０-９,，.．]*\\s*円"
JA_PERCENT_OFF = "(?iu)[0-9０-９]+\\s*[%％]\\s*(off|オフ|引き?)"
JA_POINTS = "(?iu)(ポイント|ｐｔ|pt)\\s*[0-9０-９]+\\s*倍"
# End of the fixed values.


@dataclass(frozen=True)
class TextProfile:
    """Rules for one kind of text. Regular expression classes are the inside of brackets; words are compared in lower case."""

    name: str
    terminators: str
    closers: str
    soft_breaks: str
    script: str
    noise: tuple[str, ...]
    brackets: tuple[tuple[str, str], ...]
    promo: tuple[str, ...]
    appeal: tuple[str, ...]
    weak: tuple[str, ...]
    price: str
    percent_off: str
    points: str
    decoration: str = DECORATION
    min_script_ratio: float = 0.3
    min_chars: int = 8
    max_chars: int = 140
    limit: int = 120
    prompt_chars: int = 6000
    min_ratio: float = 0.75
    fallback_ratio: float = 0.5
    min_fuzzy_chars: int = 6


JA = TextProfile(
    name="ja",
    terminators=JA_TERMINATORS,
    closers=JA_CLOSERS,
    soft_breaks=JA_SOFT_BREAKS,
    script=JA_SCRIPT,
    noise=JA_NOISE,
    brackets=JA_BRACKETS,
    promo=JA_PROMO,
    appeal=JA_APPEAL,
    weak=JA_WEAK,
    price=JA_PRICE,
    percent_off=JA_PERCENT_OFF,
    points=JA_POINTS,
)

LATIN = TextProfile(
    name="latin",
    terminators=".!?",
    closers="\"'\\)\\]",
    soft_breaks=",;:",
    script="\\p{IsLatin}",
    noise=("javascript", "cookie", "all rights reserved", "copyright"),
    brackets=(("[", "]"), ("(", ")")),
    promo=("sale", "off", "%", "free", "deal"),
    appeal=("best", "fresh", "the", "ing"),
    weak=("price", "order", "mail", "an"),
    price="[0-9][0-9,.]*\\s*(eur|usd)",
    percent_off="(?i)[0-9]+\\s*%\\s*off",
    points="(?i)pt\\s*[0-9]+\\s*x",
)
