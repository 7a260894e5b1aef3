"""Names and thresholds of the domain (fixed values)."""

SIGNAL_TYPES = ("Gathering", "Aid", "Need", "Notice", "Tension")
RESPONSE_TYPES = ("Gathering", "Aid", "Need")
CONFIDENCE_SHOWN = 0.4
#: Hours that a gathering stays after its end; days that the other types stay.
GATHERING_HOURS, NEED_DAYS, NOTICE_DAYS, CONFIRMED_DAYS = 168, 60, 90, 30
SENSITIVITY_STEPS = {"elevated": 0.005, "sensitive": 0.05}
SIMILAR, ENTRY, CORROBORATES, HEAT_SIMILAR = 0.65, 0.85, 0.92, 0.7
EARTH_KM = 6371.0
