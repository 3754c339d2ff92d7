"""spark-submit launcher for the batch job (see subrecon/plans/job.py).

    spark-submit --py-files subrecon.zip reconcile_job.py \
        --input <dir> --output <dir> --start 2024-02-01 --end 2024-02-29
"""

from subrecon.plans.job import main

if __name__ == "__main__":
    main()
