SELECT id, status, scheduled_time, started_at, finished_at
FROM {executions}
WHERE job_id = :job_id AND status = :status
ORDER BY id DESC
