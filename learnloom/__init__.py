"""Learning analytics on Spark: error diagnosis, mastery, review schedules, rewards,
mission assembly and quality metrics over an answer log and a question bank."""
