"""Display texts of captions, tables and exports. They are part of the result and must stay as they are."""

DAY_LABELS = {"weekday": "יום חול", "friday": "יום שישי", "saturday": "יום שבת"}
ALL_DAYS = "כל הימים"
WHOLE_DAY = 'סה"כ יומי'

TAG_LABELS = {"outgoing": "יוצא", "incoming": "נכנס", "internal": "פנימי"}
INTRA_ZONE = "פנים אזורי"
INTER_SELECTED = "בין אזורים נבחרים"

YES, NO = "כן", "לא"
KEY_DAY = "יום"
KEY_HOURS = "שעות"
KEY_MIN_TRIPS = "מינימום נסיעות"
KEY_SELF_LOOPS = "כולל נסיעות פנים-אזוריות"
KEY_LEVEL = "רמת אגרגציה"
KEY_FLOWS = 'סה"כ זרימות'
KEY_TRIPS = 'סה"כ נסיעות'
KEY_WARNING = "אזהרה"
KEY_ZONES = "אזורים נבחרים"
TRUNCATED_WARNING = "הנתונים גדולים מ-5,000 שורות — מוצגות 5,000 הגדולות בלבד"


def truncated_warning(cap: int) -> str:
    """The warning of a set cut at `cap` rows."""
    return TRUNCATED_WARNING.replace("5,000", f"{cap:,}")


TOTAL = 'סה"כ'
OTHERS_ID = "—"
TRIPS_WORD = "נסיעות"
OTHERS_LABEL = "אחרים (%d אזורים)"
MORE_ZONES = "ועוד %d אזורים"
