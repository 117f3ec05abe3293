"""A posts relation for checked queries: invented short posts laid over the rows of `documents`.

The driver's tables hold almost none of the vocabulary that the rules know, so every
document row gets one of these synthetic bodies (by doc_id, the first one for a null
id), followed by the whole of its own text; ages and counts follow from doc_id, with
planned nulls. Labels are never stored here: both Spark and the oracle SQL compute them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (body, author headline, link target, link text, listed email)
TEMPLATES: list[tuple[str, str, str | None, str | None, str | None]] = [
    ("We are hiring a backend engineer with Python and 3+ years of experience in Berlin. Apply now", "Recruiter at Nimbus", "https://boards.greenhouse.io/nimbus/jobs/12", "Apply", None),
    ("Now hiring: data analyst, SQL and Tableau, hybrid in Pune, CTC 12 LPA", "HR at Quillon", "https://jobs.lever.co/quillon/9", "jobs.lever.co", None),
    ("Open position for a QA tester at Zephyr Labs. Send your resume to careers@zephyrlabs.com", "Talent lead, Zephyr Labs", None, None, "careers@zephyrlabs.com"),
    ("Join our team at Orchid as product designer, remote, stipend 20k", "Orchid founder", "https://careers.orchid.io/design", "careers page", None),
    ("Hiring frontend developer, React and TypeScript, 2 years, location Dublin", "", "https://forms.gle/abc123", "form", None),
    ("We're hiring an intern, Java, Bengaluru, freshers welcome, salary 5 LPA", "Engineer", "https://lnkd.in/xyz", "lnkd.in/xyz", None),
    ("Vacancy for an accountant in London. Share your CV to anna@harborworks.co.uk", "Harbor Works", None, None, None),
    ("Looking for a devops engineer, Docker and AWS, Toronto, salary USD 90000. Apply at https://www.linkedin.com/jobs/view/77", "", None, None, None),
    ("Hiring! Comment interested and I will DM you the job description", "Growth coach", None, None, None),
    ("Open roles everywhere, like and repost for maximum reach, drop your email in the comments", "Influencer", None, None, None),
    ("We are hiring, follow me for more and tag 3 friends to get the link", "Creator", None, None, None),
    ("Referral available, comment yes below, repost for reach", "Engineer at BigCo", "https://www.linkedin.com/in/someone", "profile", None),
    ("Walk in for typing job, pay a refundable deposit and training fee, immediate joiner", "", None, None, None),
    ("Earn up to $500 per day, data entry work from home, no interview, WhatsApp us", "", "https://wa.me/123", "chat", None),
    ("Hiring now, send bank details and aadhaar to confirm, job guarantee", "Consultancy", "https://t.me/fastjobs", "telegram", None),
    ("Apply for part time work, daily payout, earn from home", "", "https://bit.ly/3xyz", "bit.ly/3xyz", "jobs.now@gmail.com"),
    ("We are hiring telecallers, ping on Telegram, write to hr.team@yahoo.co.in", "", "https://tinyurl.com/abc", "details", "hr.team@yahoo.co.in"),
    ("Hiring a writer, DM me for the job description", "Editor", None, None, None),
    ("Opening for a coordinator, mail your resume to people.hire@gmail.com", "", None, None, "people.hire@gmail.com"),
    ("We are hiring, details in the form", "", "https://docs.google.com/forms/d/1", "form", None),
    ("Hiring soon. See the hidden link", "", "https://lnkd.in/abc", "lnkd.in/abc", None),
    ("Immediate joiners wanted, notice period zero, message me on WhatsApp", "", None, None, None),
    ("#OpenToWork I am looking for a new role in design, open to opportunities", "Designer", None, None, None),
    ("Happy to share that I am starting a new position as manager at Lumen", "Manager", None, None, None),
    ("Excited to announce that I have joined Acorn as architect", "", None, None, None),
    ("I was laid off, actively seeking work, looking for my next role", "Analyst", None, None, None),
    ("Ten lessons from building a startup, thread below, follow for stories", "Founder", "https://example.org/blog/lessons", "blog", None),
    ("Our sales grew this quarter, thanks to everyone", "Sales head", None, None, None),
    ("Freshworks like tools are great. Hiring advice: read the job description twice", "", "https://node.example.com/docs", "docs", None),
    ("Acme Robotics is hiring a technician in Austin, apply at https://jobs.acmerobotics.com/open", "Lead at Acme Robotics", "https://jobs.acmerobotics.com/open/", "jobs.acmerobotics.com", None),
    ("Join Verdant Foods as officer. Share your resume with team@verdant-foods.com today", "Verdant Foods", None, None, None),
    ("Now hiring scientists, machine learning and PyTorch, Singapore, entry level", "", "https://acme.myworkdayjobs.com/en/job/5?src=post#top", "Workday", None),
    ("Hiring! two openings, entry-level, hybrid", "HR", "https://www.linkedin.com/redir/redirect?url=https%3A%2F%2Fapply.workable.com%2Fx%2F1&trk=a", "link", None),
    ("Security deposit of Rs. 2000 and processing fee, guaranteed job", "", None, None, None),
    ("Work from home, earn rs 900/day, registration fee applies, contact on whats app", "", "https://chat.whatsapp.com/G1", "group", None),
    ("We are hiring remote engineers, inbox me or send a DM", "", None, None, None),
    ("Apply now for the analyst role, experience: 2 years, Chennai, CTC 9 LPA", "", "https://smallco.zohorecruit.in/jobs", "Zoho", None),
]

COLUMNS = "k int, body string, headline string, href string, link_text string, listed_email string"


def spread(d: DataFrame) -> DataFrame:
    """The rows over all cores, several tasks for each: what follows is heavy on CPU, light on bytes.

    Files give few tasks, of unequal work (a row group is in one task, and the splits beside it are empty), so that
    the last ones run alone; from four tasks a core on this evens out, and the rows stay where they are.
    """
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(4 * cores) if d.rdd.getNumPartitions() < 4 * cores else d


def derived_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.broadcast(spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], COLUMNS))  # a literal list
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    i = F.col("doc_id")
    link = F.when(F.col("href").isNotNull(), F.array(F.struct("href", F.col("link_text").alias("text")))).otherwise(F.array().cast("array<struct<href:string,text:string>>"))
    return d.join(bodies, F.coalesce(F.pmod(i, F.lit(len(TEMPLATES))), F.lit(0)) == F.col("k")).select(
        "doc_id", "source", F.concat(F.lit("post:"), F.coalesce(i.cast("string"), F.lit("none"))).alias("post_id"), F.concat("body", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"),
        F.col("headline").alias("author_headline"), F.lit(None).cast("string").alias("age_text"),
        F.when(i % 17 == 0, None).otherwise(F.pmod(i * 7, F.lit(500)) / 2).cast("double").alias("age_hours"), F.when(i % 5 == 0, None).otherwise(F.abs(i) * 31).cast("bigint").alias("reactions"),
        F.when(i % 13 == 0, None).otherwise((F.pmod(i * 29, F.lit(320)) * F.when(i % 4 == 3, 9).otherwise(1))).cast("bigint").alias("comments"), F.lit(None).cast("bigint").alias("reposts"), link.alias("links"),
        F.when(F.col("listed_email").isNotNull(), F.array(F.lower("listed_email"))).otherwise(F.array().cast("array<string>")).alias("emails"),
    )
