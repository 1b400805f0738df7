"""Keyword lists, protocols, patterns and formats.

These have to equal the values of the described data model for results to be
right, so they are stated plainly and in their natural order. Rules are data;
no logic lives here.
"""

# --- six-domain risk rule: (key, label, keywords, level on a hit, level on a miss)
SHIPPED_RULES = [
    ("economic", "Economic Stability", ["unemploy", "job", "income", "afford"], "HIGH", "LOW"),
    ("education", "Education Access", ["english", "language", "literacy"], "HIGH", "LOW"),
    ("health_care", "Health Care Access", ["uninsur", "no doctor", "clinic"], "HIGH", "MEDIUM"),
    ("neighborhood", "Neighborhood/Built Env", ["housing", "mold", "unsafe", "food bank"], "HIGH", "LOW"),
    ("social", "Social Context", ["alone", "isolat", "no family", "no support"], "HIGH", "LOW"),
    ("transportation", "Transportation Access",
     ["no car", "no ride", "no bus", "transport", "transit", "missed appointment", "can't get to", "cannot get to"],
     "HIGH", "LOW"),
]

# --- the same domains with broadened keyword lists
IMPROVED_RULES = [
    ("economic", "Economic Stability",
     ["unemploy", "job", "income", "afford", "cost", "food insecure", "food bank", "skipping meal", "uninsur",
      "snap", "medicaid"], "HIGH", "LOW"),
    ("education", "Education Access", ["english", "language", "literacy"], "HIGH", "LOW"),
    ("health_care", "Health Care Access",
     ["uninsur", "no doctor", "clinic", "afford", "skipping medication", "medication cost", "skipping meds"],
     "HIGH", "MEDIUM"),
    ("neighborhood", "Neighborhood/Built Env",
     ["housing", "mold", "unsafe", "food bank", "food insecure"], "HIGH", "LOW"),
    ("social", "Social Context", ["alone", "isolat", "no family", "no support"], "HIGH", "LOW"),
    ("transportation", "Transportation Access",
     ["no car", "no ride", "no bus", "transport", "transit", "missed appointment", "can't get to", "cannot get to",
      "no vehicle", "cannot travel", "unable to get to", "missed visit"], "HIGH", "LOW"),
]

# --- priority: first threshold reached wins, otherwise ROUTINE
SIX_DOMAIN_THRESHOLDS = [("URGENT", 5), ("HIGH", 3)]
FIVE_DOMAIN_THRESHOLDS = [("URGENT", 4), ("HIGH", 2)]
ASSESSMENT_LABEL_WIDTH = 25

# --- five-domain evidence rule: (key, label, keywords); two hits HIGH, one MEDIUM
EVIDENCE_RULES = [
    ("economic_stability", "Economic Stability",
     ["unemploy", "job loss", "income", "afford", "food stamp", "snap", "financial", "poverty", "evict", "debt"]),
    ("education_access", "Education Access",
     ["english", "language barrier", "literacy", "ged", "dropout", "school", "education", "english as second", "esl"]),
    ("healthcare_access", "Health Care Access",
     ["uninsur", "no insurance", "transport", "no doctor", "clinic", "copay", "deductible", "appointment",
      "wait list", "telehealth"]),
    ("neighborhood_environment", "Neighborhood/Built Env",
     ["housing", "mold", "unsafe", "food bank", "food desert", "crime", "homeless", "shelter", "roach", "lead",
      "evict"]),
    ("social_context", "Social Context",
     ["alone", "isolat", "no family", "no support", "lonely", "widowed", "caregiver", "domestic", "violence",
      "abuse"]),
]

# --- care plan by label presence: (any of these words in the score text, steps)
LABEL_PLAN = [
    (["economic"], ["Connect with financial assistance programs - SNAP, Medicaid, emergency rental assistance"]),
    (["health care", "transport"], ["Schedule CHW home visit within 5 days - assess transportation barriers",
                                    "Enroll in patient transport program or telehealth if available"]),
    (["neighborhood"], ["Report housing issues to housing authority - document mold/safety concerns"]),
    (["social", "isolat"], ["Refer to community social connection program - senior center, peer support group"]),
]
# --- care plan by value: (domain that must be HIGH, step)
VALUE_PLAN = [
    ("economic", "Connect with financial assistance programs — SNAP, Medicaid, emergency rental assistance"),
    ("health_care", "Schedule CHW home visit within 5 days — assess medication-access barriers"),
    ("neighborhood", "Report housing issues to housing authority — document mold/safety concerns"),
    ("social", "Refer to community social connection program — senior center, peer support group"),
    ("transportation", "Enroll in patient transport program or telehealth if available"),
]
CLOSING_STEP = "Schedule 30-day follow-up call to assess progress on care plan goals"
PLAN_DOMAINS = ["economic", "health_care", "neighborhood", "social", "transportation"]

# --- action brief: (words naming the domain in the score text, domain key, action)
BRIEF_ACTIONS = [
    ("economic", "economic_stability",
     "Connect with financial assistance navigator (SNAP, Medicaid, emergency rental)"),
    ("health care", "healthcare_access",
     "Schedule CHW home visit — assess transportation and insurance barriers"),
    ("neighborhood", "neighborhood_environment",
     "Report housing concerns — document and refer to housing authority"),
    ("social", "social_context", "Refer to social connection program — peer support or senior center"),
]
BRIEF_URGENT = ["IMMEDIATE: Warm transfer to supervising CHW or social worker",
                "Document all HIGH-risk domains in care management system"]
BRIEF_CLOSING = "Schedule 30-day follow-up call to assess progress"
BRIEF_LABELS = {"URGENT": "URGENT — same-day outreach required", "HIGH": "HIGH — outreach within 48 hours",
                "ROUTINE": "ROUTINE — schedule standard follow-up"}

# --- screening protocols: (any of these words, protocols); defaults when nothing matches
PROTOCOL_RULES = [
    (["diabetes", "hba1c", "glucose"],
     ["ADA Diabetes Distress Screening (Problem Areas in Diabetes scale)",
      "Food Insecurity Screening - Hunger Vital Sign 2-item tool",
      "AADE7 Self-Care Behaviors assessment for diabetes management barriers"]),
    (["hypertension", "blood pressure"],
     ["AHA Hypertension Social Needs Screening Tool", "Housing Instability Screening - iHELP instrument"]),
    (["heart", "chf", "bnp"],
     ["ACC/AHA Social Determinants of Cardiovascular Risk Protocol",
      "Social Isolation and Loneliness Screening - UCLA Loneliness Scale (3-item)"]),
    (["depress", "phq", "mental"],
     ["PHQ-9 Depression Screening with SDoH integration workflow",
      "Social Connection and Support Network Assessment"]),
    (["food", "nutrition", "anemia"],
     ["USDA Household Food Security Survey Module (2-item screen)",
      "WIC Referral and Community Food Resource Navigation Protocol"]),
    (["housing", "transport", "financial", "uninsured"],
     ["PRAPARE SDoH Screening Tool", "Community Health Worker Navigation Referral Protocol"]),
]
PROTOCOL_DEFAULTS = ["PRAPARE Universal SDoH Screening Tool", "NACHC Social Needs Screening and Referral Workflow"]

# --- community resources by zip prefix: (prefix, name, category, phone, services)
COMMUNITY_RESOURCES = [
    ("021", "Greater Boston Food Bank", "food", "617-427-5200",
     "Emergency food pantry, SNAP enrollment assistance"),
    ("021", "Heading Home", "housing", "617-864-8140", "Emergency shelter, rapid rehousing, eviction prevention"),
    ("021", "MBTA Ride Program", "transportation", "617-222-5123", "Paratransit for medical appointments"),
    ("021", "Boston Medical Center HealthNet", "healthcare", "617-414-5110",
     "Sliding-scale primary care, telehealth, care navigation"),
    ("021", "NAMI Massachusetts", "mental_health", "617-580-7755",
     "Peer support, crisis helpline, mental health navigation"),
    ("100", "City Harvest", "food", "646-412-0600", "Mobile food pantry, community fridge network"),
    ("100", "Coalition for the Homeless", "housing", "212-776-2000",
     "Drop-in center, street outreach, transitional housing"),
    ("100", "NYC Health + Hospitals", "healthcare", "844-692-4692",
     "Sliding-scale care, financial counseling, community health workers"),
]
FALLBACK_RESOURCES = [
    ("Local 211 Helpline", "all", "211", "Call 211 for local resources — food, housing, health, crisis services"),
    ("Community Health Center", "healthcare", "Call 211", "Federally Qualified Health Center — sliding-scale care"),
    ("Area Agency on Aging", "all", "eldercare.acl.gov",
     "Services for adults 60+ — meals, transportation, caregiver support"),
]

# --- message header status codes
MESSAGE_STATUS = {1: "Queued", 2: "Delivered", 3: "Acknowledged", 4: "Error", 5: "Discarded", 6: "Aborted",
                  7: "Suspended", 8: "Cancelled", 9: "Completed"}
# --- component kinds of the message spans: kind -> (prefix, operation, span kind)
MESSAGE_SPAN_KINDS = {"service": ("bs.", "receive", "Server"), "process": ("bp.", "process", "Internal"),
                      "operation": ("bo.", "send", "Client")}
# --- message flow of one follow-up: (source, target, body class)
FOLLOWUP_FLOW = [("SDoHFollowUpBS", "SDoHFollowUpBP", "FollowUpRequest"),
                 ("SDoHFollowUpBP", "SDoHFollowUpBO", "FollowUpRequest"),
                 ("SDoHFollowUpBO", "SDoHFollowUpBP", "FollowUpResponse"),
                 ("SDoHFollowUpBP", "SDoHFollowUpBS", "FollowUpResponse")]

# --- personal health information: patterns in rule order, field lists, per-source policy
PHI_PATTERNS = [
    ("FULL_NAME", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    ("DATE_WITH_DAY", r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-]\d{4}\b"
                      r"|\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("MRN", r"(?i)(?:mrn|medical.record|patient.id|#)\s*:?\s*([A-Z0-9]{6,10})\b"),
    ("HEALTH_PLAN", r"(?i)(?:health.plan|beneficiary|member.id|group.id)\s*:?\s*([A-Z0-9]{6,15})\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ZIP_CODE", r"\b\d{5}(?:-\d{4})?\b"),
]
# a text without the marks of a rule cannot match it: plain words (any one is
# enough, compared in lower case) or a short expression that every match contains
PHI_MARK_WORDS = {"EMAIL": ["@"], "MRN": ["mrn", "medical", "patient", "#"],
                  "HEALTH_PLAN": ["health", "beneficiary", "member", "group"]}
PHI_MARK_PATTERNS = {"DATE_WITH_DAY": r"\d{4}", "PHONE": r"\d{3}", "SSN": r"\d{3}-\d{2}", "IP_ADDRESS": r"\d\.\d",
                     "ZIP_CODE": r"\d{5}"}
PHI_PATTERN_SCORE = 0.5
PHI_SAFE_FIELDS = ["sdoh_domain", "sdoh_score", "risk_level", "protocol_id", "loinc_code", "snomed_code",
                   "icd10_code", "claim_id", "encounter_type"]
PHI_BLOCKED_FIELDS = ["patient_name", "first_name", "last_name", "date_of_birth", "dob", "mrn",
                      "medical_record_number", "ssn", "social_security", "phone", "fax", "email", "address",
                      "zip_code", "account_number", "health_plan_number", "device_identifier", "ip_address", "url"]
PHI_GLOBAL_THRESHOLD = 0.35
PHI_SOURCES = [
    ("fhir", 0.3, ["patient_name", "date_of_birth", "mrn", "address", "phone", "email"]),
    ("sdoh_assessment", 0.35, ["patient_name", "date_of_birth"]),
    ("prior_auth", 0.3, ["patient_name", "date_of_birth", "ssn", "health_plan_number"]),
]

# --- payload de-identification
HEALTH_WORDS = ["patient", "encounter", "medication", "claim", "fhir"]
DEIDENTIFY_PATTERNS = [(r"(?i)patient\s+name\s*[:=]\s*[^,\n]+", "Patient Name=[REDACTED]"),
                       (r"(?i)\b(name|mrn|ssn|dob)\s*[:=]\s*[^,\n]+", "$1=[REDACTED]")]
DEIDENTIFY_FAIL_MARK = "FAIL_DEID"
DEIDENTIFY_REMEDIATION = (
    "FAIL_CLOSED: Healthcare payload preprocessing failed. Remediation: verify de-identification rules and "
    "re-run with minimum necessary fields. Details: de-identification failed for payload")

# --- trace attributes kept in a rendered tree, access map, policy and other small tables
TREE_ATTRIBUTES = ["gen_ai.tool.input", "gen_ai.tool.output", "gen_ai.tool.error", "gen_ai.request.model",
                   "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.tool.denied",
                   "gen_ai.system", "gen_ai.tool.call_id", "session.id"]
SCOPE_ROLES = [("mcp.read", "SampleReader"), ("mcp.write", "SampleWriter"), ("mcp.admin", "SampleAdmin")]
ACTION_ROLES = {"list": ["caller", "approver", "admin"], "run_agents": ["caller", "approver", "admin"],
                "invoke_read_tools": ["caller", "approver", "admin"], "invoke_write_tools": ["approver", "admin"],
                "approve": ["approver", "admin"]}
APPROVAL_POLICY = {"required_for": ["write"], "exempt_tools": [], "extra_tools": []}
CODED_SYSTEMS = ["http://snomed.info/sct", "http://hl7.org/fhir/sid/icd-10", "http://hl7.org/fhir/sid/icd-10-cm"]
STATUS_TRANSITIONS = [("UNRESOLVED", "RESOLVED"), ("UNRESOLVED", "DEFERRED"), ("DEFERRED", "RESOLVED")]
FOLLOWUP_PRIORITIES = ["routine", "urgent", "emergent"]
TERMINAL_STATES = ["succeeded", "failed", "cancelled"]
GAP_PLACEHOLDERS = [
    "These gaps will be filled automatically by the KB Mining pipeline.",
    "Run the KB Mining notebook to auto-generate articles for these gaps.",
    "The KB Mining pipeline will extract patterns from resolved tickets and populate this section.",
]
GAP_REPLACEMENT = "*Partially addressed — see AI-generated section below.*"
LEAK_PHRASES = ["affording insulin", "wife passed", "skipping meals", "mold issues"]
