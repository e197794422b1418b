"""Classes, and what is told about each. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes, in the order of the score vector.
CLASSES = ["Normal", "Pneumonia", "Tuberculosis", "COVID-19", "Lung Cancer", "COPD", "Pleural Effusion"]
#: Classes that are urgent above a confidence, in percent.
URGENCY = {"emergency": (("Lung Cancer", "COVID-19"), 70.0), "urgent": (("Tuberculosis", "Pleural Effusion", "Pneumonia"), 60.0)}
#: Weights of the composite score.
COMPOSITE = {"f1_score": 0.4, "accuracy": 0.3, "auc_roc": 0.2, "recall": 0.1}
#: The result that stands in where no model is there, in percent.
DEMO = {"Normal": 4.2, "Pneumonia": 82.4, "Tuberculosis": 7.1, "COVID-19": 3.1, "Lung Cancer": 1.5, "COPD": 1.2, "Pleural Effusion": 0.5}
#: What an image of a class shows, as label and value.
FINDINGS = {
    "Normal": [("Opacity", "Absent"), ("Consolidation", "None"), ("Pleural effusion", "Absent"), ("Hyperinflation", "Normal")],
    "Pneumonia": [("Opacity", "Present"), ("Consolidation", "Lobar/patchy"), ("Pleural effusion", "May be present"), ("Air bronchogram", "Present")],
    "Tuberculosis": [("Opacity", "Upper lobe"), ("Cavitation", "Possible"), ("Lymphadenopathy", "Present"), ("Miliary pattern", "Possible")],
    "COVID-19": [("Ground-glass opacity", "Bilateral"), ("Consolidation", "Peripheral"), ("Pleural effusion", "Rare"), ("Distribution", "Bilateral lower")],
    "Lung Cancer": [("Mass lesion", "Present"), ("Hilar enlargement", "Possible"), ("Pleural effusion", "Possible"), ("Atelectasis", "Possible")],
    "COPD": [("Hyperinflation", "Present"), ("Flattened diaphragm", "Present"), ("Bullae", "Possible"), ("Vascular markings", "Reduced")],
    "Pleural Effusion": [("Opacity", "Basal"), ("Blunting of angle", "Present"), ("Mediastinal shift", "Possible"), ("Consolidation", "Compression")],
}
#: Fixed value: for other classes.
DEFAULT_FINDINGS = [("Finding", "Indeterminate")]
#: What a patient is told with a class.
PRECAUTIONS = {
    "Normal": [
        "Continue regular health check-ups every 6–12 months.",
        "Maintain a smoke-free lifestyle.",
        "Exercise regularly to keep lungs healthy.",
        "Ensure proper ventilation in living/working spaces.",
    ],
    "Pneumonia": [
        "Seek immediate medical attention for antibiotic prescription.",
        "Rest and stay well hydrated (2–3 litres of fluids per day).",
        "Avoid exposure to cold air and crowds.",
        "Monitor oxygen saturation; seek emergency care if below 94%.",
        "Complete the full antibiotic course even if symptoms improve.",
    ],
    "Tuberculosis": [
        "Isolate yourself to avoid spreading infection.",
        "Begin DOTS (Directly Observed Treatment Short-course) immediately.",
        "Wear N95 mask around others.",
        "Notify close contacts for screening.",
        "Complete the 6–9 month treatment course without interruption.",
    ],
    "COVID-19": [
        "Self-isolate for at least 10 days from symptom onset.",
        "Monitor oxygen levels with a pulse oximeter.",
        "Seek hospital care if SpO2 drops below 94%.",
        "Stay hydrated and rest adequately.",
        "Follow local health authority guidelines.",
    ],
    "Lung Cancer": [
        "Consult an oncologist immediately for staging and treatment plan.",
        "Quit smoking completely — this is critical.",
        "Discuss biopsy and PET scan with your physician.",
        "Explore clinical trials if eligible.",
        "Seek psychological and palliative care support.",
    ],
    "COPD": [
        "Use prescribed bronchodilators and inhalers as directed.",
        "Quit smoking — the single most impactful intervention.",
        "Enrol in a pulmonary rehabilitation programme.",
        "Get annual flu and pneumococcal vaccinations.",
        "Avoid air pollutants, dust, and chemical fumes.",
    ],
    "Pleural Effusion": [
        "Consult a pulmonologist to identify the underlying cause.",
        "Thoracentesis (fluid drainage) may be required.",
        "Limit strenuous physical activity until reviewed.",
        "Monitor breathing difficulty and report worsening immediately.",
        "Address underlying causes such as heart failure or infection.",
    ],
}
#: For other classes.
DEFAULT_PRECAUTIONS = ["Consult a pulmonologist for detailed evaluation.", "Undergo further diagnostic tests as advised."]
#: Fixed value.
DISCLAIMER = (
    "This is an AI-generated analysis for academic and decision-support purposes only. "
    "It must not replace clinical examination by a qualified medical professional. "
    "Always verify findings with a licensed radiologist or physician."
)
#: Fixed value: the record of uploads without a patient.
DEFAULT_PATIENT = {"patient_id": "DEFAULT", "name": "Unregistered Patient", "age": 0, "gender": "Unknown"}


def told(condition: Column, values: dict[str, list], otherwise: list) -> Column:
    """What is told about a condition, as a map of constants: no join is needed for seven classes."""
    made = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), _array(v))))
    return F.coalesce(F.try_element_at(made, condition), _array(otherwise))


def _array(values: list) -> Column:
    return F.array(*(F.struct(F.lit(v[0]).alias("label"), F.lit(v[1]).alias("value")) if isinstance(v, tuple) else F.lit(v) for v in values))
