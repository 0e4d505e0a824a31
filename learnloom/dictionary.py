"""Illustration token dictionary: icons, aliases, categories and scenes."""

# Token -> icon, grouped by category.
ICONS = {
    "transport": {"でんしゃ": "🚆", "バス": "🚌", "ひこうき": "✈️", "くるま": "🚗", "じてんしゃ": "🚲"},
    "animal": {
        "いぬ": "🐶", "ねこ": "🐱", "さかな": "🐟", "とり": "🐦", "うま": "🐴",
        "にわとり": "🐔", "すずめ": "🐦", "はと": "🕊️",
    },
    "food": {
        "りんご": "🍎", "みかん": "🍊", "さくらんぼ": "🍒", "ぶどう": "🍇", "ばなな": "🍌",
        "きゅうり": "🥒", "アイス": "🍨", "パン": "🍞", "カレー": "🍛", "うどん": "🍜",
        "ケーキ": "🍰", "ジュース": "🧃", "ぎゅうにゅう": "🥛", "みず": "💧",
    },
    "school": {
        "がっこう": "🏫", "としょかん": "📚", "えんぴつ": "✏️", "けしごむ": "🧽",
        "ノート": "📓", "ランドセル": "🎒", "ほん": "📘",
    },
    "wear": {"ぼうし": "🧢", "てぶくろ": "🧤", "ふく": "👕", "くつ": "👟", "かさ": "☂️", "ヘルメット": "⛑️"},
    "nature": {
        "うみ": "🌊", "こうえん": "🏞️", "やま": "⛰️", "かわ": "🏞️", "そら": "☁️", "あめ": "🌧️",
        "たいふう": "🌪️", "かみなり": "⚡", "ひ": "🔥", "つき": "🌙", "ほし": "⭐",
    },
    "time": {"あさ": "🌅", "ひる": "☀️", "よる": "🌃", "ごご": "🕒"},
    "shape": {"まる": "⚪", "さんかく": "🔺", "しかく": "⬜", "あか": "🔴", "あお": "🔵", "きいろ": "🟡"},
    "action": {"はしる": "🏃", "まつ": "⏳", "つかう": "🛠️", "たべる": "🍽️", "のむ": "🥤", "あそぶ": "🎲"},
    "money": {
        "おかね": "💴", "1えん": "🪙", "5えん": "🪙", "10えん": "🪙", "50えん": "🪙",
        "100えん": "🪙", "500えん": "🪙", "1000えん": "💴",
    },
}

# Alias -> token.
ALIASES = {
    "いぬさん": "いぬ", "ねこさん": "ねこ", "さかなさん": "さかな", "えんぴつ5ほん": "えんぴつ",
    "けしごむ2こ": "けしごむ", "みち": "でんしゃ", "ルート": "でんしゃ", "コース": "でんしゃ",
}

# Scenes (skill id, title, background, tags, default tokens).
SCENES = [
    ("clock_hour", "とけい", "classroom", ["time", "clock"], ["あさ", "ひる", "よる"]),
    ("clock_half", "とけい", "classroom", ["time", "clock"], ["あさ", "ひる", "よる"]),
    ("clock_quarter", "とけい", "classroom", ["time", "clock"], ["あさ", "ひる", "よる"]),
    ("money_value", "おかね", "shop", ["money", "count"], ["おかね"]),
    ("money_sum", "おかね", "shop", ["money", "sum"], ["おかね"]),
    ("money_change", "おつり", "shop", ["money", "change"], ["おかね"]),
    ("fractions_basic", "ぶんすう", "classroom", ["math", "fraction"], ["ケーキ"]),
    ("route_optimization", "ルート", "logic_board", ["insight", "strategy"], ["でんしゃ", "バス", "ひこうき"]),
    ("odd_one_out", "なかまさがし", "logic_board", ["insight", "classification"], ["りんご", "みかん", "ぶどう"]),
    ("safety_road", "こうつうあんぜん", "road", ["life", "safety"], ["じてんしゃ", "ヘルメット", "くるま"]),
    ("safety_disaster", "ぼうさい", "home", ["life", "safety"], ["あめ", "たいふう", "かみなり"]),
    ("life_routine", "せいかつしゅうかん", "home", ["life", "habit"], ["ふく", "くつ", "みず"]),
    ("cooking_step", "りょうり", "kitchen", ["life", "cooking"], ["パン", "カレー", "みず"]),
]
